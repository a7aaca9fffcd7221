"""The explorer (EXP), table statistics and ingest reports (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.functions.columns import MOVE_END, move_to_uci
from ludograph.operators import explorer as E
from ludograph.operators import reports
from ludograph.operators.replay import index_rows, line_state
from ludograph.plans.explorer_table import ExplorerTable

START = "0|0|0|0|0"
FIRST = "1|0|0|0|0"  # after one click

_AGG = """cast(count(*) as bigint) as games, cast(sum(case when result = 1 then 1 else 0 end) as bigint) as white,
  cast(sum(case when result = 3 then 1 else 0 end) as bigint) as draws, cast(sum(case when result = 2 then 1 else 0 end) as bigint) as black"""
_ELO = "cast(floor(sum(elo) / count(elo) + 0.5) as int) as avg_elo, max(year) as last_year"


@check("exp_01_explore", f"with {V.P} select hash, move, {_AGG}, {_ELO} from p where hash = '{START}' group by hash, move")
def explore(spark, d):
    return E.explore(V.positions(spark, d), START)


@check("exp_02_mean_rating", f"with {V.P} select move, {_ELO.split(', max')[0]} from p where hash = '{FIRST}' group by move")
def mean_rating(spark, d):
    return E.explore(V.positions(spark, d), FIRST).select("move", "avg_elo")


@check("exp_03_totals", f"with {V.P} select hash, {_AGG} from p group by hash")
def totals(spark, d):
    return E.totals(E.explore_all(V.positions(spark, d)))


@check("exp_04_ended", f"with {V.P} select hash, cast(sum(case when move = '{V.END}' then 1 else 0 end) as bigint) as ended from p group by hash")
def ended(spark, d):
    return E.ended(E.explore_all(V.positions(spark, d)), V.END)


@check(
    "exp_05_order_moves",
    f"""with {V.P} select move, games, cast(row_number() over (order by games desc, move) as int) as rank from
    (select move, cast(count(*) as bigint) as games from p where hash = '{START}' and move <> '{V.END}' group by move)""",
)
def order_moves(spark, d):
    from pyspark.sql import Window

    # One state's distinct moves: a handful of rows, so the position in the order may be shown.
    ordered = E.order_moves(E.moves(E.explore(V.positions(spark, d), START), V.END))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("games"), "move"))
    return ordered.select("move", "games", rank.alias("rank"))


@check("exp_06_explore_all", f"with {V.P} select hash, move, {_AGG}, {_ELO} from p group by hash, move")
def explore_all(spark, d):
    return E.explore_all(V.positions(spark, d))


@check("exp_07_top_games", f"with {V.P} select game_id, cast(ply as bigint) as ply, elo, year, result from p where hash = '{START}' order by elo desc nulls last, game_id desc limit 8")
def top_games(spark, d):
    return E.top_games(V.positions(spark, d), START)


@check("exp_07b_top_games_all", f"""with {V.P} select * from (select hash, cast(row_number() over (partition by hash order by elo desc nulls last, game_id desc) as int) as rank,
  game_id, cast(ply as bigint) as ply, elo from p) where rank <= 8""")
def top_games_all(spark, d):
    return E.top_games_all(V.positions(spark, d), 8)


@check("exp_08_recent_games", f"with {V.P} select game_id, cast(ply as bigint) as ply, elo, year, result from p where hash = '{START}' order by year desc nulls last, game_id desc limit 8")
def recent_games(spark, d):
    return E.recent_games(V.positions(spark, d), START)


@check("exp_08b_recent_games_all", f"""with {V.P} select * from (select hash, cast(row_number() over (partition by hash order by year desc nulls last, game_id desc) as int) as rank,
  game_id, cast(ply as bigint) as ply, year from p) where rank <= 8""")
def recent_games_all(spark, d):
    return E.recent_games_all(V.positions(spark, d), 8)


@check(
    "exp_09_report",
    f"""with {V.P},
    mv as (select hash, move, {_AGG}, {_ELO} from p group by hash, move),
    heads as (select hash, cast(sum(games) as bigint) as games, cast(sum(white) as bigint) as white, cast(sum(draws) as bigint) as draws,
      cast(sum(black) as bigint) as black, cast(sum(case when move = '{V.END}' then games else 0 end) as bigint) as ended,
      coalesce(string_agg(case when move <> '{V.END}' then move || ':' || games || ':' || white || ':' || draws || ':' || black || ':' || avg_elo || ':' || last_year end, ',' order by games desc, move), '') as moves
      from mv group by hash),
    top as (select hash, string_agg(cast(game_id as varchar) || '@' || cast(ply as varchar), ',' order by elo desc, game_id desc) as top_games from
      (select *, row_number() over (partition by hash order by elo desc, game_id desc) as rn from p) where rn <= 3 group by hash),
    rec as (select hash, string_agg(cast(game_id as varchar) || '@' || cast(ply as varchar), ',' order by year desc, game_id desc) as recent_games from
      (select *, row_number() over (partition by hash order by year desc, game_id desc) as rn from p) where rn <= 3 group by hash),
    ref as (select hash, 'state ' || hash as name from plies where ply between 1 and 2 group by hash)
    select heads.*, top.top_games, rec.recent_games, ref.name from heads left join top using (hash) left join rec using (hash) left join ref using (hash)""",
)
def report(spark, d):
    from checks.sequences import state_names

    r = E.explorer_report(V.positions(spark, d), names=state_names(spark, d), k=3, end=V.END)
    move = lambda m: F.concat_ws(":", m["move"], *[m[c].cast("string") for c in ("games", "white", "draws", "black", "avg_elo", "last_year")])
    game = lambda g: F.concat(g["game_id"].cast("string"), F.lit("@"), g["ply"].cast("string"))
    text = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return r.select(
        "hash", "games", "white", "draws", "black", "ended",
        text("moves", move), text("top_games", game), text("recent_games", game), "name",
    )


@check(
    "exp_09b_report_of_games",
    f"""with {V.P}, mv as (select hash, upper(move) as shown, count(*) as games from p where move <> '{V.END}' group by hash, shown),
    ranked as (select *, row_number() over (partition by hash order by elo desc, game_id desc) as rn from p)
    select heads.hash, moves, top_games from
    (select hash, string_agg(shown || ':' || games, ',' order by games desc, shown) as moves from mv group by hash) heads
    join (select hash, string_agg(r.game_id || ':' || f.n || ':' || f.final, ',' order by r.rn) as top_games
      from ranked r join facts f on f.game_id = r.game_id where rn <= 3 group by hash) top using (hash)""",
)
def report_of_games(spark, d):
    """Moves by their text, and games with columns of their display rows."""
    shown = V.sessions(spark, d).select("game_id", "n", "final")
    r = E.explorer_report(V.positions(spark, d), k=3, end=V.END, text=F.upper, games=shown).where(F.size("moves") > 0)
    move = lambda m: F.concat_ws(":", m["text"], m["games"].cast("string"))
    game = lambda g: F.concat_ws(":", *[g[c].cast("string") for c in ("game_id", "n", "final")])
    return r.select("hash", *[F.array_join(F.transform(c, f), ",").alias(c) for c, f in (("moves", move), ("top_games", game))])


@check(
    "exp_10_explore_line",
    f"""with {V.CHESS} select case when m > 4 then ucis[5] else '{V.END}' end as uci, cast(count(*) as bigint) as games,
      cast(sum(case when result = 1 then 1 else 0 end) as bigint) as white, cast(sum(case when result = 3 then 1 else 0 end) as bigint) as draws,
      cast(sum(case when result = 2 then 1 else 0 end) as bigint) as black
    from c where line in (2, 3) and m >= 4 group by 1""",
)
def explore_line(spark, d):
    """A typed line of moves; games that reach its state by another order count too."""
    from checks.sequences import played

    pos = played(spark, d).select(F.inline(index_rows(60)), F.col("id").alias("game_id"), "result")
    pos = pos.withColumn("elo", F.lit(None).cast("int")).withColumn("year", F.lit(None).cast("int"))
    table = E.explore(pos, line_state(["d4", "d5", "c4", "e6"]))
    uci = F.when(F.col("move") == MOVE_END, V.END).otherwise(move_to_uci("move"))
    return table.select(uci.alias("uci"), "games", "white", "draws", "black")


@check(
    "exp_11_guard",
    f"""with {V.EV}, rows as (select event_id, dom as hash, step as epd from ev),
    n as (select hash, epd, count(*) as n from rows group by hash, epd),
    best as (select hash, arg_min(epd, (-n, epd)) as epd from (select hash, epd, n from n) group by hash)
    select event_id, r.hash, r.epd from rows r join best b on b.hash = r.hash and b.epd = r.epd""",
)
def guard(spark, d):
    rows = V.events(spark, d).select("event_id", F.col("dom").alias("hash"), F.col("step").alias("epd"))
    return E.guard(rows).select("event_id", "hash", "epd")


@check("exp_12_materialised", f"with {V.P} select hash, move, {_AGG}, {_ELO} from p group by hash, move")
def materialised(spark, d):
    """The stored explorer table, read back (built once per data version)."""
    from ludograph.plans.tables import Store, Tables

    store = Store(spark, V.scratch(spark))
    facts = V.sessions(spark, d).select(F.col("game_id").alias("id"), F.col("year").alias("date"), "result", "elo")
    store.append(Tables(facts, V.positions(spark, d)), V.HORIZON)
    store.materialise_explorer()
    return store.explorer()


@check(
    "exp_13_opening_tree",
    f"""with {V.P},
    t as (select hash, move, cast(count(*) as bigint) as games from p where move <> '{V.END}' group by hash, move),
    k as (select *, cast(row_number() over (partition by hash order by games desc, move) as int) as rank from t),
    best as (select * from k where rank <= 3),
    links as (select hash, move, min(child) as child from (select game_id, ply, hash, move, lead(hash) over (partition by game_id order by ply) as child from plies) where child is not null group by hash, move),
    l1 as (select * from best where hash = '{START}'),
    l2 as (select b.* from best b where b.hash in (select child from l1 join links using (hash, move)))
    select hash, move, games, rank, 1 as level from l1 union all select hash, move, games, rank, 2 as level from l2""",
)
def opening_tree(spark, d):
    table = ExplorerTable(spark, V.scratch(spark)).write(E.explore_all(V.positions(spark, d, child=True)))
    return table.tree(START, 2, 3, V.END)


@check(
    "flt_17_state_filters",
    f"with {V.P} select hash, move, {_AGG} from p where elo >= 20 and elo <= 80 and year >= 5 and year <= 25 group by hash, move",
)
def state_filters(spark, d):
    f = E.StateFilter(min_elo=20, max_elo=80, year_from=5, year_to=25)
    return E.explore_all(V.positions(spark, d), f).select("hash", "move", "games", "white", "draws", "black")


@check(
    "prj_13_shares",
    f"""with {V.P}, t as (select hash, move, {_AGG} from p group by hash, move) select hash, move,
    round(100.0 * white / games, 6) as white_pct, round(100.0 * draws / games, 6) as draw_pct, round(100.0 * black / games, 6) as black_pct from t where move <> '{V.END}'""",
)
def shares(spark, d):
    rows = E.moves(E.explore_all(V.positions(spark, d)), V.END)
    return rows.select("hash", "move", *[F.round(c, 6).alias(c) for c in ("white_pct", "draw_pct", "black_pct")])


@check(
    "agg_01_stats",
    f"""with {V.G}, {V.P} select (select cast(count(*) as bigint) from g) as games,
      (select cast(count(distinct n) as bigint) from (select lower(white) as n from g union all select lower(black) from g)) as players,
      (select cast(count(distinct lower(event)) as bigint) from g) as events, (select cast(count(*) as bigint) from p) as positions, 60 as horizon""",
)
def stats(spark, d):
    return E.stats(V.games(spark, d), V.positions(spark, d), V.HORIZON)


def statuses(spark, d):
    """Documents as an import: short ones fail, repeated texts are duplicates; one batch per source."""
    from ludograph.operators.dims import dedupe

    docs = V.table(spark, d, "documents").withColumn("fingerprint", F.md5("text"))
    bad = F.col("n_chars") < 300
    good = docs.filter(~bad)
    kept = dedupe(good.select("doc_id", "fingerprint"), "fingerprint", "doc_id").select("doc_id", F.lit(True).alias("_ok"))
    rows = docs.join(kept, "doc_id", "left")
    return rows.select(
        F.col("source").alias("batch"), F.col("doc_id").alias("seq"),
        F.when(bad, "error").when(F.col("_ok"), "ok").otherwise("duplicate").alias("status"),
        F.when(bad, F.concat(F.lit("too short: "), F.col("n_chars").cast("string"))).alias("message"),
        F.when(F.col("_ok") & (F.col("doc_id") % 11 == 0), "odd").alias("warning"),
    )


_STATUS = """docs as (select *, row_number() over (partition by text, n_chars < 300 order by doc_id) as rn from documents),
  st as (select source as batch, doc_id as seq, case when n_chars < 300 then 'error' when rn = 1 then 'ok' else 'duplicate' end as status,
  case when n_chars < 300 then 'too short: ' || cast(n_chars as varchar) end as message,
  case when n_chars >= 300 and rn = 1 and doc_id % 11 = 0 then 'odd' end as warning from docs)"""


@check(
    "agg_02_ingest_report",
    f"""with {_STATUS}, c as (select batch, cast(sum(case when status = 'ok' then 1 else 0 end) as bigint) as imported,
      cast(sum(case when status = 'duplicate' then 1 else 0 end) as bigint) as duplicates, cast(sum(case when status = 'error' then 1 else 0 end) as bigint) as errors,
      cast(sum(case when warning is not null then 1 else 0 end) as bigint) as warnings from st group by batch),
    f as (select batch, string_agg(text, ',' order by seq) as samples from (select batch, seq, coalesce(message, warning) as text,
      row_number() over (partition by batch order by seq) as rn from st where coalesce(message, warning) is not null) where rn <= 20 group by batch)
    select c.*, samples from c left join f using (batch) order by batch desc limit 50""",
)
def ingest_report(spark, d):
    report = reports.ingest_report(statuses(spark, d))
    return reports.history(report.withColumn("samples", F.array_join("samples", ",")))
