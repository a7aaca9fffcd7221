"""Filters (FLT), joins (JON), sorting and paging (SRT, LIM), name suggestion (SET-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.operators import search as S

_IDS = f"with {V.G} select id from g where "


def _filter(name: str, where: str, condition) -> None:
    """One filter over G: the ids it keeps."""

    @check(name, _IDS + where)
    def run(spark, d):
        g = V.games(spark, d)
        c = condition()
        return (g if c is None else g.filter(c)).select("id")


_filter("flt_01_contains_ci", "contains(lower(event), 'ring')", lambda: S.contains_ci("event", "  RinG "))
_filter("flt_01b_contains_literal", "contains(lower(site), 'n_1')", lambda: S.contains_ci("site", "N_1"))
_filter("flt_02_player", "contains(lower(white), '00001') or contains(lower(black), '00001')", lambda: S.player("00001"))
_filter("flt_02b_player_white", "contains(lower(white), '#00000001')", lambda: S.player("#00000001", "white"))
_filter("flt_02c_player_black", "contains(lower(black), '#00000001')", lambda: S.player("#00000001", "black"))
_filter("flt_03_player_exact", "lower(white) = 'customer#000000012' or lower(black) = 'customer#000000012'", lambda: S.player(" CUSTOMER#000000012", exact=True))
_filter(
    "flt_04_opponent",
    "(contains(lower(white), '0007') or contains(lower(black), '0007')) and (contains(lower(white), '002') or contains(lower(black), '002'))",
    lambda: S.player("0007") & S.opponent("002"),
)
_filter("flt_04b_opponent_of_white", "contains(lower(white), '0007') and contains(lower(black), '002')", lambda: S.player("0007", "white") & S.opponent("002", "white"))
_filter("flt_05_white_black", "contains(lower(white), '0012') and contains(lower(black), '001')", lambda: S.contains_ci("white", "0012") & S.contains_ci("black", "001"))
_filter("flt_06_event_site_opening", "contains(lower(event), 'red') and contains(lower(site), 'nation_1') and contains(lower(opening), 'm')", lambda: S.contains_ci("event", "RED") & S.contains_ci("site", "nation_1") & S.contains_ci("opening", "M"))
_filter("flt_07_date_between", "date >= 19960300 and date <= 19971231", lambda: S.date_between("1996.03", "1997"))
_filter("flt_07b_date_ignored", "date <= 19970231", lambda: S.date_between("spring", "1997-2"))
_filter("flt_08_result", "result = 1", lambda: S.result("1-0"))
_filter("flt_09_result_win", "(result = 1 and contains(lower(white), '0003')) or (result = 2 and contains(lower(black), '0003'))", lambda: S.result("win", "0003"))
_filter("flt_09b_result_loss", "(result = 2 and contains(lower(white), '0003')) or (result = 1 and contains(lower(black), '0003'))", lambda: S.result("loss", "0003"))
_filter("flt_10_ratings", "min_elo >= 1500 and max_elo <= 3500", lambda: S.at_least("min_elo", 1500) & S.at_most("max_elo", 3500))
_filter("flt_11_eco_exact", "eco = 'B11'", lambda: S.eco("b11"))
_filter("flt_11b_eco_prefix", "eco like 'B1%'", lambda: S.eco("B1"))
_filter("flt_11c_eco_range", "eco between 'B11' and 'C22'", lambda: S.eco("b11 - c22"))
_filter("flt_12_plies", "plies >= 3 and plies <= 5", lambda: S.plies_between(3, 5))
_filter("flt_13_moves", "plies >= 3 and plies <= 6", lambda: S.moves_between(2, 3))
_filter("flt_14_annotated", "movetext is not null", lambda: S.annotated(True))
_filter("flt_14b_not_annotated", "movetext is null", lambda: S.annotated(False))


def state_games(spark, d):
    """Sessions as games, for searches by state."""
    s = V.sessions(spark, d)
    return s.select(F.col("game_id").alias("id"), "result", "elo", F.col("n").alias("plies"))


@check("flt_15_reached", f"with {V.P} select q.game_id as id, q.result, cast(f.n as bigint) as plies, cast(q.ply as bigint) as ply from p q join facts f using (game_id) where hash = '1|0|1|0|0'")
def reached(spark, d):
    return S.reached(state_games(spark, d), V.positions(spark, d), "1|0|1|0|0").select("id", "result", "plies", "ply")


# All filters together, in the shapes of typical searches.
QUERIES = {
    "a": (S.GameQuery(player="0001", result="win", date_from="1994"), "(contains(lower(white),'0001') or contains(lower(black),'0001')) and date >= 19940000 and ((result=1 and contains(lower(white),'0001')) or (result=2 and contains(lower(black),'0001')))"),
    "b": (S.GameQuery(min_elo=2700), "min_elo >= 2700"),
    "c": (S.GameQuery(player="Customer#00000", color="white", date_from="1995", date_to="1996.06", min_elo=2000), "contains(lower(white),'customer#00000') and date >= 19950000 and date <= 19960631 and min_elo >= 2000"),
    "d": (S.GameQuery(eco="C", opening="o", annotated=True, max_elo=3000), "eco like 'C%' and contains(lower(opening),'o') and movetext is not null and max_elo <= 3000"),
    "e": (S.GameQuery(white="1", black="2", event="b", site="nation_2", min_plies=2, max_plies=6, result="1/2-1/2"), "contains(lower(white),'1') and contains(lower(black),'2') and contains(lower(event),'b') and contains(lower(site),'nation_2') and plies >= 2 and plies <= 6 and result = 3"),
    "f": (S.GameQuery(opponent="5", result="win", min_elo=0, eco="Z99", date_from="?"), "true"),
    "g": (S.GameQuery(player="Customer#000000025", player_exact=True, opponent="supplier", color="white"), "lower(white) = 'customer#000000025' and contains(lower(black),'supplier')"),
}


@check(
    "flt_16_search",
    f"with {V.G} " + " union all ".join(f"select '{k}' as q, id from g where {w}" for k, (_, w) in QUERIES.items()),
)
def search_all(spark, d):
    g = V.games(spark, d)
    out = None
    for k, (q, _) in QUERIES.items():
        part = S.matching(g, q).select(F.lit(k).alias("q"), "id")
        out = part if out is None else out.unionByName(part)
    return out


_ROWS = f"""select id, white, black, white_elo, black_elo, event, site, {V.DATE_SQL} as date, {V.RESULT_SQL} as result, eco, opening, plies,
  cast(ceil(plies / 2.0) as int) as moves, movetext is not null as annotated"""


@check("flt_16b_search_page", f"with {V.G} {_ROWS} from (select * from g where min_elo >= 1200 order by date asc nulls first, id asc limit 40 offset 10)")
def search_page(spark, d):
    return S.search(V.games(spark, d), S.GameQuery(min_elo=1200, sort="date", order="asc", limit=40, offset=10))


@check("flt_16c_search_by_state", f"with {V.P} select q.game_id as id, cast(q.ply as bigint) as ply from p q join facts f using (game_id) where hash = '1|0|0|0|0' and f.n >= 3 and q.result = 1")
def search_by_state(spark, d):
    q = S.GameQuery(state="1|0|0|0|0", min_plies=3, result="1-0")
    return S.matching(state_games(spark, d), q, V.positions(spark, d)).select("id", "ply")


@check("flt_18_get_game", f"with {V.G} select id, white, black, plies from g where id = 77")
def get_game(spark, d):
    return S.get_game(V.games(spark, d), 77).select("id", "white", "black", "plies")


def id_games(spark, d):
    """Orders with ids in place of names, and the dimensions they point at."""
    t = lambda n: V.table(spark, d, n)
    players = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    games = spark.sql(
        """select o.o_orderkey as id, o.o_custkey as white_id, o.o_orderkey % (select count(*) from {customer}) as black_id,
             case when o.o_orderkey % 4 <> 0 then o.o_orderkey % (select count(*) from {part}) end as event_id,
             case when o.o_orderkey % 3 <> 0 then cast(o.o_orderkey % 30 as bigint) end as site_id,
             o.o_custkey % 7 as opening_id from {orders} o""",
        customer=t("customer"), part=t("part"), orders=t("orders"),
    )
    dims = {
        "players": players,
        "events": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "sites": t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")),
        "openings": t("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")),
    }
    return games, dims


_IDG = """ig as (select o.o_orderkey as id, o.o_custkey as white_id, o.o_orderkey % (select count(*) from customer) as black_id,
  case when o.o_orderkey % 4 <> 0 then o.o_orderkey % (select count(*) from part) end as event_id,
  case when o.o_orderkey % 3 <> 0 then o.o_orderkey % 30 end as site_id, o.o_custkey % 7 as opening_id from orders o)"""


@check(
    "jon_01_with_names",
    f"""with {_IDG} select ig.id, w.c_name as white, b.c_name as black, p_name as event, n_name as site, r_name as opening from ig
    join customer w on w.c_custkey = white_id join customer b on b.c_custkey = black_id left join part on p_partkey = event_id
    left join nation on n_nationkey = site_id left join region on r_regionkey = opening_id""",
)
def with_names(spark, d):
    games, dims = id_games(spark, d)
    return S.with_names(games, dims["players"], dims["events"], dims["sites"], dims["openings"])


@check(
    "jon_02_semi",
    f"""with {_IDG} select id from ig where white_id in (select c_custkey from customer where contains(lower(c_name), '0007'))
      or black_id in (select c_custkey from customer where contains(lower(c_name), '0007'))""",
)
def semi(spark, d):
    games, dims = id_games(spark, d)
    return S.semi(games, dims["players"], ["white_id", "black_id"], S.contains_ci("name", "0007")).select("id")


@check("jon_03_state_games", f"with {V.P} select f.game_id as id, cast(f.n as bigint) as plies, cast(q.ply as bigint) as ply from p q join facts f using (game_id) where hash = '0|1|0|0|0'")
def state_join(spark, d):
    return S.reached(state_games(spark, d), V.positions(spark, d), "0|1|0|0|0").select("id", "plies", "ply")


@check(
    "jon_04_in_order",
    f"""with {V.G}, refs as (select l_orderkey as id, min(l_partkey) * 100000 + l_orderkey as pos from lineitem group by l_orderkey)
    select id, pos, white from refs join g using (id)""",
)
def in_order(spark, d):
    lines = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("part"))
    refs = lines.select("id", (F.col("part") * 100000 + F.col("id")).alias("pos"))
    return S.in_order(refs, V.games(spark, d)).select("id", "pos", "white")


_SORTS = [("white", "asc", "lower(white) asc, id asc"), ("elo", "desc", "min_elo desc nulls last, id desc"),
          ("elo", "asc", "min_elo asc nulls first, id asc"), ("eco", "asc", "eco asc, id asc"), ("result", "desc", "result desc, id desc"),
          ("plies", "desc", "plies desc, id desc"), ("whiteElo", "desc", "white_elo desc nulls last, id desc"), ("nothing", "desc", "id desc"),
          ("black", "desc", "lower(black) desc, id desc"), ("event", "asc", "lower(event) asc, id asc"), ("date", "desc", "date desc nulls last, id desc"),
          ("blackElo", "asc", "black_elo asc nulls first, id asc")]


@check(
    "srt_01_sort_games",
    f"with {V.G} " + " union all ".join(f"select '{k} {o}' as key, id from (select id from g order by {s} limit 25)" for k, o, s in _SORTS),
)
def sort_games(spark, d):
    g = V.games(spark, d)
    out = None
    for key, order, _ in _SORTS:
        part = S.page(S.sort_games(g, key, order), 0, 25).select(F.lit(f"{key} {order}").alias("key"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@check("srt_01b_sorted", f"with {V.G} select id, white, date from g order by date desc, id desc")
def sorted_all(spark, d):
    return S.sort_games(V.games(spark, d), "date", "desc").select("id", "white", "date")


@check("lim_01_page", f"with {V.G} select id, date from g order by date desc nulls last, id desc limit 50 offset 100")
def page(spark, d):
    return S.page(S.sort_games(V.games(spark, d), "date", "desc"), 100, 50).select("id", "date")


@check("lim_02_capped_count", f"with {V.G}, n as (select count(*) as n from g where result = 1) select cast(least(n, 500) as bigint) as total, n > 500 as capped from n")
def capped_count(spark, d):
    rows = S.capped_count(S.matching(V.games(spark, d), S.GameQuery(result="1-0")), 500)
    return rows.select(F.col("total").cast("bigint").alias("total"), "capped")


@check("lim_03_after", f"with {V.G} select id, white from g where result = 2 and id > 500 order by id limit 100")
def after(spark, d):
    return S.after(S.matching(V.games(spark, d), S.GameQuery(result="0-1")), 500, 100).select("id", "white")


def _suggest_sql(column: str, table: str, text: str) -> str:
    return f"""select name, cast(row_number() over (order by rank, lower(name), name) as int) as pos from
      (select distinct {column} as name, case when starts_with(lower({column}), '{text}') then 0 else 1 end as rank from {table}
       where contains(lower({column}), '{text}')) order by rank, lower(name), name limit 15"""


def _suggest(spark, d, table, column, text):
    from pyspark.sql import Window

    names = V.table(spark, d, table).select(F.col(column).alias("name"))
    top = S.suggest(names, text).select("name", "rank")
    # At most 15 rows: their place in the list may be shown.
    return top.select("name", F.row_number().over(Window.orderBy("rank", F.lower("name"), "name")).alias("pos"))


@check("set_01_suggest", _suggest_sql("p_name", "part", "re"))
def suggest(spark, d):
    return _suggest(spark, d, "part", "p_name", " Re")


@check("set_01b_suggest_players", _suggest_sql("c_name", "customer", "12"))
def suggest_players(spark, d):
    return _suggest(spark, d, "customer", "c_name", "12")


@check("prj_12_rows", f"with {V.G} {_ROWS} from g")
def rows(spark, d):
    return S.to_rows(V.games(spark, d))
