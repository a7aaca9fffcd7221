"""Dimensions (DIM) and duplicates (DED)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.operators import dims as D


def mixed(spark, d):
    """Games whose player names come in different spellings of case."""
    g = V.games(spark, d)
    k = F.col("id") % 3
    return g.select(
        "id",
        F.when(k == 0, F.upper("white")).when(k == 1, F.lower("white")).otherwise(F.col("white")).alias("white"),
        F.when(F.col("id") % 2 == 0, F.upper("black")).otherwise(F.col("black")).alias("black"),
        F.when(F.col("id") % 4 != 0, F.upper("event")).alias("event"),
    )


_MIXED = f"""{V.G}, mx as (select id, case cast(id % 3 as int) when 0 then upper(white) when 1 then lower(white) else white end as white,
  case when id % 2 = 0 then upper(black) else black end as black, case when id % 4 <> 0 then upper(event) end as event from g),
names as (select white as name, id * 2 as seq from mx union all select black, id * 2 + 1 from mx),
dim as (select lower(name) as name_key, arg_min(name, seq) as name, min(seq) as seq, cast(row_number() over (order by min(seq)) as bigint) as id from names group by lower(name)),
ev as (select lower(event) as k, arg_min(event, id) as name, cast(row_number() over (order by min(id)) as bigint) as id from mx where event is not null group by lower(event))"""


def player_dim(spark, d):
    return D.build_dim(D.names_of(mixed(spark, d), ["white", "black"], "id"))


@check("dim_01_build", f"with {_MIXED} select id, name, seq from dim")
def build(spark, d):
    return player_dim(spark, d).select("id", "name", "seq")


@check(
    "dim_02_resolve",
    f"""with {_MIXED} select mx.id, w.id as white_id, b.id as black_id, e.id as event_id from mx left join dim w on w.name_key = lower(mx.white)
    left join dim b on b.name_key = lower(mx.black) left join ev e on e.k = lower(mx.event)""",
)
def resolve(spark, d):
    g = mixed(spark, d)
    players = player_dim(spark, d)
    events = D.build_dim(D.names_of(g, ["event"], "id"))
    return D.resolve_dims(g, [("white", players, "white_id"), ("black", players, "black_id"), ("event", events, "event_id")])


@check(
    "dim_03_extend",
    """with old as (select cast(row_number() over (order by c_custkey) as bigint) as id, c_name as name from customer where c_custkey % 3 <> 0),
    new as (select c_name as name, cast(row_number() over (order by c_custkey) as bigint) + (select max(id) from old) as id from customer where c_custkey % 3 = 0)
    select id, name from old union all select id, name from new""",
)
def extend(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    old = D.build_dim(c.filter(F.col("seq") % 3 != 0))
    again = c.withColumn("name", F.upper("name"))  # the second batch repeats known names in capitals
    batch = c.filter(F.col("seq") % 3 == 0).unionByName(again.filter(F.col("seq") % 3 == 1))
    return D.extend_dim(old, batch)


def marked(spark, d):
    """Documents with a duplicate key: text and language, short ones also by source."""
    docs = V.table(spark, d, "documents")
    key = D.fingerprint([F.lower("text"), "lang"], "n_chars", ["source"], short=500)
    return docs.select("doc_id", "n_chars", key.alias("fingerprint"))


_FP = """md5(case when n_chars < 500 then concat_ws(chr(1), lower(text), lang, source) else concat_ws(chr(1), lower(text), lang) end)"""


@check("ded_01_fingerprint", f"select doc_id, {_FP} as fingerprint from documents")
def fingerprint(spark, d):
    return marked(spark, d).select("doc_id", "fingerprint")


@check("ded_02_dedupe", f"select min(doc_id) as doc_id, {_FP} as fingerprint from documents group by 2")
def dedupe(spark, d):
    return D.dedupe(marked(spark, d), "fingerprint", "doc_id").select("doc_id", "fingerprint")


@check(
    "ded_03_only_new",
    f"with f as (select doc_id, {_FP} as fp from documents) select doc_id from f where doc_id % 2 = 1 and fp not in (select fp from f where doc_id % 2 = 0)",
)
def only_new(spark, d):
    m = marked(spark, d)
    return D.only_new(m.filter(F.col("doc_id") % 2 == 1), m.filter(F.col("doc_id") % 2 == 0)).select("doc_id")


@check(
    "snk_01c_star_schema",
    f"""with {_MIXED}, st as (select lower(site) as k, arg_min(site, id) as name from g where id % 6 <> 0 and site is not null group by lower(site))
    select mx.id, w.name as white, b.name as black, e.name as event, st.name as site, g.opening from mx join g using (id)
    join dim w on w.name_key = lower(mx.white) join dim b on b.name_key = lower(mx.black) left join ev e on e.k = lower(mx.event)
    left join st on g.id % 6 <> 0 and st.k = lower(g.site)""",
)
def star_schema(spark, d):
    """Names -> ids -> names: every name comes back in its first spelling."""
    from ludograph.plans.star import from_star, to_star

    g = V.games(spark, d).select("id", F.when(F.col("id") % 6 != 0, F.col("site")).alias("site"), "opening", "eco")
    named = mixed(spark, d).join(g, "id")
    return from_star(to_star(named)).select("id", "white", "black", "event", "site", "opening")
