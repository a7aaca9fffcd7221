"""The stored star schema, loaded with sessions in two imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from checks.sources import JOB, _LINES, _SESSION_GAMES, session_records
from ludograph.functions import text as X
from ludograph.operators.jobs import StepCounts
from ludograph.operators.search import GameQuery
from ludograph.plans.ingest import Options
from ludograph.plans.star import from_star
from ludograph.plans.star_store import StarStore
from ludograph.sources.records import read_records

_PART = "case when game_id % 3 = 1 then 1 else 0 end"  # the second import takes every third day


def loaded(spark, d, job=JOB, options=Options()):
    base = V.scratch(spark)
    store = StarStore(spark, f"{base}/db")
    names = JOB.named(spark.createDataFrame(_LINES, "eco string, name string, moves string"))
    rows = session_records(spark, d)
    for part in (0, 1):
        path = f"{base}/records{part}"
        some = rows.filter((F.col("k") % 3 == 1) == bool(part)).repartitionByRange(3, "k").sortWithinPartitions("k")
        some.select("raw").write.option("lineSep", "\n").text(path)
        store.load(read_records(spark, path), names, options, states=job)
    return store


@check("snk_01d_star_store", _SESSION_GAMES)
def star_store(spark, d):
    """Names -> stored ids -> names, over two imports."""
    rows = from_star(loaded(spark, d).star())
    return rows.select(F.col("round").cast("bigint").alias("session"), "white", "event", F.col("date").cast("bigint").alias("date"),
                       F.col("result").cast("bigint").alias("result"), F.col("plies").cast("bigint").alias("plies"), "opening", "eco")


@check("dim_03b_lasting_ids", f"""with {V.P}, n as (select 'User ' || cast(game_id // 100000000 as varchar) as name, {_PART} as part, game_id * 2 as seq from facts
    union all select '?', {_PART}, game_id * 2 + 1 from facts),
  first as (select name, min(part * 1000000000000000 + seq) as place from n group by name)
  select cast(row_number() over (order by place) as bigint) as id, name from first""")
def lasting_ids(spark, d):
    """A second import adds the users that were not there, behind the ids given before. No day has a second player."""
    return loaded(spark, d).names("players").select("id", "name")


_STAR = f"with s as ({_SESSION_GAMES})"


@check("flt_16d_star_search", f"""{_STAR}, i as (select *, row_number() over (order by case when session % 3 = 1 then 1 else 0 end, session) as id from s)
  select session, white, event, opening from i where contains(lower(white), 'user 1') and contains(lower(opening), 'click') and result = 1
  order by lower(white) desc, id desc limit 40""")
def star_search(spark, d):
    """Filters by names of two dictionaries, sorted by a third column's names, on the stored ids."""
    store = loaded(spark, d)
    page = store.search(GameQuery(player="user 1", opening="click", color="white", result="win", sort="white", limit=40))
    rounds = store.table("games").select("id", F.col("round").cast("bigint").alias("session"))
    return page.join(rounds, "id").select("session", "white", "event", "opening")


_FEW = tuple(s for s in V.STEPS if s != "signup")
_FIRST_BAD = "select game_id, min(ply) + 1 as place from steps where step = 'signup' group by game_id"


@check("snk_04c_rejects", f"""with {V.P} select game_id as session, cast({_PART} as bigint) as batch, 'unknown step "signup" at ply ' || cast(place as varchar) as message
  from ({_FIRST_BAD}) b""")
def rejects(spark, d):
    """Days with a step that the vocabulary lacks are rejected; their texts are kept."""
    bad = loaded(spark, d, StepCounts(_FEW), Options(reject_warned=True)).rejects().where("file is not null and line is not null")
    return bad.select(F.element_at(X.tags("raw"), "Round").cast("bigint").alias("session"), "batch", "message")


@check("agg_02b_stored_reports", f"""with {V.P}, b as ({_FIRST_BAD}), n as (select {_PART} as part, b.game_id is not null as bad from facts f left join b using (game_id))
  select cast(part + 1 as bigint) as version, cast(part as bigint) as batch, cast(sum(case when bad then 0 else 1 end) as bigint) as imported,
    cast(0 as bigint) as duplicates, cast(sum(case when bad then 1 else 0 end) as bigint) as errors from n group by part""")
def stored_reports(spark, d):
    return loaded(spark, d, StepCounts(_FEW), Options(reject_warned=True)).reports().select("version", "batch", "imported", "duplicates", "errors")


@check("lim_03b_after_place", f"""{_STAR}, i as (select *, row_number() over (order by case when session % 3 = 1 then 1 else 0 end, session) as id from s)
  select session, date from i where date > 20240110 order by date, id limit 200""")
def after_place(spark, d):
    """The next games behind a (date, id), by the files' keys."""
    rows = loaded(spark, d).after(20240110, 1 << 60, 200)
    return rows.select(F.col("round").cast("bigint").alias("session"), F.col("date").cast("bigint").alias("date"))


@check("dml_03b_delete_by_sizes", f"with {V.P} select cast(count(distinct game_id) as bigint) as games, cast(count(*) as bigint) as positions from p where game_id % 5 <> 0")
def delete_by_sizes(spark, d):
    """A deletion is counted from the sizes of the games that go."""
    store = loaded(spark, d)
    gone = store.table("games").where(F.col("round").cast("bigint") % 5 == 0).select("id")
    store.delete(gone)
    return store.meta().orderBy(F.desc("version")).limit(1).select("games", "positions")
