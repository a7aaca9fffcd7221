"""Scalar columns (PRJ) and text output (FMT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.functions import columns as C


@check(
    "prj_01_clean",
    """with t as (select doc_id, case cast(doc_id % 7 as int) when 0 then ' ? ' when 1 then '-' when 2 then '???' else '  ' || text || chr(10) end as v from documents)
    select doc_id, case when c not in ('', '?', '-', '??', '???') then md5(c) end as clean from (select doc_id, trim(regexp_replace(v, '[ \\t\\r\\n]+', ' ', 'g')) as c from t)""",
)
def clean(spark, d):
    k = F.col("doc_id") % 7
    v = F.when(k == 0, " ? ").when(k == 1, "-").when(k == 2, "???").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n")))
    return V.table(spark, d, "documents").select("doc_id", F.md5(C.clean(v)).alias("clean"))


_Y, _M, _D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"


@check(
    "prj_02_partial_date",
    f"""select o_orderkey as id, cast(case cast(o_orderkey % 8 as int)
      when 0 then {_Y} * 10000 + {_M} * 100 + {_D}
      when 1 then {_Y} * 10000 + {_M} * 100
      when 2 then {_Y} * 10000
      when 3 then {_Y} * 10000
      when 4 then null
      when 5 then {_Y} * 10000
      when 6 then {_Y} * 10000 + {_M} * 100
      else null end as int) as date from orders""",
)
def partial_date(spark, d):
    k, day = F.col("o_orderkey") % 8, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(day, "yyyy/MM-dd")).when(k == 1, F.date_format(day, "yyyy.MM.'??'"))
        .when(k == 2, F.date_format(day, "yyyy.'??'.dd")).when(k == 3, F.date_format(day, "' 'yyyy' '"))
        .when(k == 4, F.date_format(day, "'????'.MM.dd")).when(k == 5, F.date_format(day, "yyyy'.13.'dd"))
        .when(k == 6, F.date_format(day, "yyyy-MM'-32T10'")).otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.parse_partial_date(text).alias("date"))


@check(
    "prj_03_first_date",
    f"""select o_orderkey as id, cast(case when o_orderkey % 3 = 0 then 19990000 when o_orderkey % 3 = 1 then {_Y} * 10000 + {_M} * 100 + {_D}
      when o_orderkey % 2 = 0 then {_Y} * 10000 end as int) as date from orders""",
)
def first_date(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    a = F.when(k % 3 == 0, "1999.??.??").otherwise("????.01.01")
    b = F.when(k % 3 == 1, F.date_format(day, "yyyy.MM.dd"))
    c = F.when(k % 2 == 0, F.date_format(day, "yyyy")).otherwise("n/a")
    return V.table(spark, d, "orders").select(k.alias("id"), C.first_date(a, b, c).alias("date"))


@check(
    "prj_04_format_date",
    f"""with {V.G} select id, case when id % 9 = 0 then '????.??.??' else {V.DATE_SQL} end as date,
      case when id % 9 = 0 then '????' else replace({V.DATE_SQL}, '.??', '') end as short from g""",
)
def format_date(spark, d):
    date = F.when(F.col("id") % 9 != 0, F.col("date"))
    return V.games(spark, d).select(
        "id", C.format_partial_date(date).alias("date"), C.format_partial_date(date, short=True).alias("short")
    )


@check(
    "prj_05_rating",
    """select event_id, case when r between 1 and 3999 then cast(r as int) end as rating from
      (select event_id, case when event_id % 5 = 4 then null else k * (event_id % 90) end as r from
        (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events))""",
)
def rating(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint") * (F.col("event_id") % 90)
    text = F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("x"), k.cast("string"))).otherwise(
        F.concat(F.lit(" "), k.cast("string"), F.lit(" (est.)"))
    )
    return V.table(spark, d, "events").select("event_id", C.parse_rating(text).alias("rating"))


@check(
    "prj_06_result",
    f"with {V.G} select id, {V.RESULT_SQL} as text, result as code, 0 as other from g",
)
def result(spark, d):
    g = V.games(spark, d).select("id", C.result_text("result").alias("text"))
    return g.select(
        "id", "text", C.result_code("text").cast("int").alias("code"), C.result_code(F.concat("text", F.lit(" "))).cast("int").alias("other")
    )


@check("prj_07_ratings", f"with {V.G} select id, min_elo, max_elo, elo from g")
def ratings(spark, d):
    return V.games(spark, d).select("id", "min_elo", "max_elo", "elo")


@check("prj_08_year", f"with {V.G} select id, cast(date // 10000 as smallint) as year from g")
def year(spark, d):
    return V.games(spark, d).select("id", C.year_of("date").alias("year"))


@check(
    "prj_09_eco_or",
    f"""with {V.G} select id, case when id % 4 in (0, 1) then eco else 'A00' end as eco from g""",
)
def eco_or(spark, d):
    k = F.col("id") % 4
    tag = F.when(k == 0, F.lower("eco")).when(k == 1, F.concat(F.lit(" "), F.col("eco"))).when(k == 2, F.concat(F.col("eco"), F.lit("a"))).otherwise("?")
    return V.games(spark, d).select("id", C.eco_or(tag, F.lit("A00")).alias("eco"))


@check(
    "prj_10_extra_tags",
    """select event_id, case when event_id % 3 = 0 then null else '{"k":"' || json_extract_string(props, '$.k') || '"}' end as tags from events""",
)
def extra_tags(spark, d):
    main = F.create_map(F.lit("White"), F.col("event_type"), F.lit("ECO"), F.lit("A00"))
    tags = F.when(F.col("event_id") % 3 == 0, main).otherwise(F.map_concat(main, C.json_tags("props")))
    return V.table(spark, d, "events").select("event_id", C.extra_tags(tags).alias("tags"))


@check(
    "prj_11_json_tags",
    "select event_id, 'k' as name, json_extract_string(props, '$.k') as value from events",
)
def json_tags(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.explode(C.json_tags("props")).alias("name", "value"))
    return rows


# ---- text output --------------------------------------------------------------------------------


def head(spark, d):
    """G with the columns of a header list."""
    return V.games(spark, d).withColumn("round", F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))).withColumn(
        "site", F.when(F.col("id") % 5 != 0, F.col("site"))
    ).withColumn("start_state", F.when(F.col("id") % 7 == 0, "8/8/8/4k3/8/8/4P3/4K3 w - - 0 1")).withColumn(
        "tags", F.when(F.col("id") % 3 == 0, F.to_json(F.create_map(F.lit("Mode"), F.concat(F.lit('a "'), F.col("opening"), F.lit('" \\'))))) 
    )


def header_list():
    return C.headers(
        event="event", site="site", date="date", round="round", white="white", black="black", result="result",
        white_elo="white_elo", black_elo="black_elo", eco="eco", opening="opening",
        tags=C.json_tags("tags"), start_state="start_state",
    )


_HEAD = f"""h as (select *, case when id % 2 = 0 then cast(id as varchar) else '?' end as rnd, case when id % 5 <> 0 then site else '?' end as st from g),
heads as (select id, movetext, result, unnest([
  {{'n': 'Event', 'v': coalesce(event, '?'), 'o': 1}}, {{'n': 'Site', 'v': coalesce(st, '?'), 'o': 2}}, {{'n': 'Date', 'v': {V.DATE_SQL}, 'o': 3}},
  {{'n': 'Round', 'v': rnd, 'o': 4}}, {{'n': 'White', 'v': white, 'o': 5}}, {{'n': 'Black', 'v': black, 'o': 6}}, {{'n': 'Result', 'v': {V.RESULT_SQL}, 'o': 7}},
  {{'n': 'WhiteElo', 'v': cast(white_elo as varchar), 'o': 8}}, {{'n': 'BlackElo', 'v': cast(black_elo as varchar), 'o': 9}},
  {{'n': 'ECO', 'v': eco, 'o': 10}}, {{'n': 'Opening', 'v': opening, 'o': 11}},
  {{'n': 'Mode', 'v': case when id % 3 = 0 then 'a "' || opening || '" \\' end, 'o': 12}},
  {{'n': 'SetUp', 'v': case when id % 7 = 0 then '1' end, 'o': 13}},
  {{'n': 'FEN', 'v': case when id % 7 = 0 then '8/8/8/4k3/8/8/4P3/4K3 w - - 0 1' end, 'o': 14}}]) as x from h),
hl as (select id, movetext, result, x.n as name, x.v as value, x.o as o from heads where x.v is not null)"""


@check("fmt_01_headers", f"with {V.G}, {_HEAD} select id, cast(row_number() over (partition by id order by o) - 1 as int) as pos, name, value from hl")
def headers(spark, d):
    rows = head(spark, d).select("id", F.posexplode(header_list()).alias("pos", "h"))
    return rows.select("id", "pos", "h.name", "h.value")


def _numbered(offset: str) -> str:
    ply = f"(i + {offset})"
    return f"""case when {ply} % 2 = 0 then cast({ply} // 2 + 1 as varchar) || '. ' when i = 0 then cast({ply} // 2 + 1 as varchar) || '... ' else '' end"""


@check(
    "fmt_02_movetext",
    f"""with {V.CHESS}, t as (select id, result, id % 2 as off, unnest(range(0, cast(m as bigint))) as i, sans from c)
    select id, string_agg({_numbered('off')} || sans[i + 1], ' ' order by i) || ' ' || max({V.RESULT_SQL}) as text from t group by id""",
)
def movetext(spark, d):
    from checks.sequences import played

    g = played(spark, d)
    sans = F.slice("tokens", F.lit(1), F.size("moves"))
    return g.select("id", C.movetext_of(sans, C.result_text("result"), (F.col("id") % 2).cast("int")).alias("text"))


@check(
    "fmt_03_wrap",
    r"""with t as (select doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) as t from documents)
    select doc_id, md5(t) as words, true as fits, true as full_lines from t""",
)
def wrap(spark, d):
    """Same words, no line over 80 (single longer words aside), no word that would fit on the line before."""
    rows = V.table(spark, d, "documents").select("doc_id", F.split(C.wrap("text", 80), "\n").alias("lines"))
    first = lambda x: F.substring_index(x, " ", 1)
    nexts = F.concat(F.transform(F.slice("lines", F.lit(2), F.size("lines")), first), F.array(F.lit("?" * 90)))
    return rows.select(
        "doc_id", F.md5(F.array_join("lines", " ")).alias("words"),
        F.forall("lines", lambda x: (F.length(x) <= 80) | ~x.contains(" ")).alias("fits"),
        F.forall(F.zip_with("lines", nexts, lambda a, b: F.length(a) + 1 + F.length(b)), lambda n: n > 80).alias("full_lines"),
    )


@check(
    "fmt_04_record",
    f"""with {V.G}, {_HEAD} select id, string_agg('[' || name || ' "' || replace(replace(value, '\\', '\\\\'), '"', '\\"') || '"]', chr(10) order by o)
      || chr(10) || chr(10) || coalesce(max(movetext), max({V.RESULT_SQL})) || chr(10) as record from hl group by id""",
)
def record(spark, d):
    plain = C.movetext_of(F.array().cast("array<string>"), C.result_text("result"))
    return head(spark, d).select("id", C.format_record(header_list(), F.coalesce("movetext", plain)).alias("record"))
