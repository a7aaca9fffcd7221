"""The explorer: next-step statistics of one state, or of all states at once.

Works on the state index: ``hash, move, game_id, ply, result, elo, year``. The result codes are
1/2/3 = first side wins / second side wins / draw; other codes count as games only. The common
first state holds a row of every game, so nothing here groups or windows raw rows by state alone
without a map-side reduction first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.functions.columns import MOVE_END, share
from ludograph.operators.skew import largest, top_k
from ludograph.session import staged


@dataclass(frozen=True)
class StateFilter:
    """Rating and year ranges. 0 and None mean no bound; unknown values fail a bound."""

    min_elo: int | None = None
    max_elo: int | None = None
    year_from: int | None = None
    year_to: int | None = None

    def condition(self) -> Column | None:
        parts = []
        for value, column, upper in (
            (self.min_elo, "elo", False), (self.max_elo, "elo", True),
            (self.year_from, "year", False), (self.year_to, "year", True),
        ):
            if value:
                parts.append(F.col(column) <= value if upper else F.col(column) >= value)
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def state_filters(positions: DataFrame, f: StateFilter | None) -> DataFrame:
    condition = f.condition() if f else None
    return positions if condition is None else positions.filter(condition)


def _stats() -> list[Column]:
    won = lambda code: F.sum((F.col("result") == code).cast("bigint"))
    return [
        F.count(F.lit(1)).alias("games"),
        won(1).alias("white"),
        won(3).alias("draws"),
        won(2).alias("black"),
        F.sum(F.col("elo").cast("bigint")).alias("_elo_sum"),
        F.count("elo").alias("_elo_n"),
        F.max("year").alias("last_year"),
    ]


def _mean() -> Column:
    # Halves round up, as for the mean of two ratings.
    return F.floor(F.col("_elo_sum") / F.col("_elo_n") + 0.5).cast("int").alias("avg_elo")


_TABLE = ["games", "white", "draws", "black"]


def explore_all(positions: DataFrame, f: StateFilter | None = None) -> DataFrame:
    """Next-step table of every state: one map-side reduced aggregation over the index. An index that says where steps
    lead (``child``) gives a table that does."""
    child = ["child"] if "child" in positions.columns else []
    rows = state_filters(positions, f).groupBy("hash", "move").agg(*_stats(), *[F.min(c).alias(c) for c in child])
    return rows.select("hash", "move", *_TABLE, _mean(), "last_year", *child)


def explore(positions: DataFrame, state, f: StateFilter | None = None) -> DataFrame:
    """Next-step table of one state; the literal reaches the file scan."""
    return explore_all(positions.filter(F.col("hash") == F.lit(state)), f)


def totals(table: DataFrame) -> DataFrame:
    """Totals per state from a next-step table (``explore_all``), ended games included."""
    return table.groupBy("hash").agg(*[F.sum(c).alias(c) for c in _TABLE])


def ended(table: DataFrame, end=MOVE_END) -> DataFrame:
    """Games that stopped in each state, from a next-step table."""
    games = F.sum(F.when(F.col("move") == end, F.col("games")).otherwise(0))
    return table.groupBy("hash").agg(games.alias("ended"))


def moves(table: DataFrame, end=MOVE_END) -> DataFrame:
    """A next-step table without the end marker, with win shares in percent."""
    return table.filter(F.col("move") != end).select(
        "*",
        share("white", "games").alias("white_pct"),
        share("draws", "games").alias("draw_pct"),
        share("black", "games").alias("black_pct"),
    )


def order_moves(table: DataFrame, text: str = "move") -> DataFrame:
    """Most played first, then by move text."""
    return table.orderBy(F.desc("games"), F.col(text))



def _recent() -> list[Column]:
    return [F.desc("year"), F.desc("game_id")]


def _best() -> list[Column]:
    return [F.desc("elo"), F.desc("game_id")]


def clamp_k(k: int) -> int:
    return max(0, min(int(k), 50))


def top_games(positions: DataFrame, state, k: int = 8, f: StateFilter | None = None) -> DataFrame:
    """Best rated games through one state (top-k per task, then merged; no sort of all rows)."""
    rows = state_filters(positions.filter(F.col("hash") == F.lit(state)), f)
    return rows.orderBy(*_best()).limit(clamp_k(k)).select("game_id", "ply", "elo", "year", "result")


def recent_games(positions: DataFrame, state, k: int = 8, f: StateFilter | None = None) -> DataFrame:
    rows = state_filters(positions.filter(F.col("hash") == F.lit(state)), f)
    return rows.orderBy(*_recent()).limit(clamp_k(k)).select("game_id", "ply", "elo", "year", "result")


def top_games_all(positions: DataFrame, k: int = 8) -> DataFrame:
    """Best rated games of every state; hot states are split by game before they come together."""
    rows = top_k(positions, ["hash"], _best(), clamp_k(k), salt="game_id")
    return rows.select("hash", "rank", "game_id", "ply", "elo")


def recent_games_all(positions: DataFrame, k: int = 8) -> DataFrame:
    rows = top_k(positions, ["hash"], _recent(), clamp_k(k), salt="game_id")
    return rows.select("hash", "rank", "game_id", "ply", "year")


def explorer_report(
    positions: DataFrame, state=None, *, names: DataFrame | None = None, k: int = 8, end=MOVE_END,
    f: StateFilter | None = None, text: Callable[[Column], Column] | None = None, games: DataFrame | None = None,
) -> DataFrame:
    """One row per state: totals, ended games, ranked moves, best and latest games, name.

    ``state=None`` reports every state. The index is read once: sums and the leading games are kept together for each
    (state, move), and shrink before the shuffle. The lists hold distinct moves and at most k games. ``names`` is
    (hash, eco, name). ``text`` shows a move; moves with equally many games go by it. ``games`` are display rows by
    ``game_id``, whose columns the listed games get; they are joined to those games only.
    """
    rows = state_filters(positions if state is None else positions.filter(F.col("hash") == F.lit(state)), f)
    k = clamp_k(k)
    best, recent = (F.struct(c, "game_id", "ply") for c in ("elo", "year"))
    table = rows.groupBy("hash", "move").agg(*_stats(), largest(best, k).alias("_best"), largest(recent, k).alias("_recent"))
    table = table.select("hash", "move", *_TABLE, _mean(), "last_year", "_best", "_recent")
    shown = [] if text is None else [text(F.col("move")).alias("text")]
    entry = F.struct((-F.col("games")).alias("_order"), *shown, "move", *_TABLE, "avg_elo", "last_year")
    listed = F.sort_array(F.collect_list(F.when(F.col("move") != end, entry)))

    def leading(name: str) -> Column:
        found = F.slice(F.sort_array(F.flatten(F.collect_list(name)), asc=False), 1, k)
        return F.transform(found, lambda g: F.struct(g["game_id"].alias("game_id"), g["ply"].alias("ply")))

    out = table.groupBy("hash").agg(
        *[F.sum(c).alias(c) for c in _TABLE],
        F.sum(F.when(F.col("move") == end, F.col("games")).otherwise(0)).alias("ended"),
        F.transform(listed, lambda e: e.dropFields("_order")).alias("moves"),
        leading("_best").alias("top_games"), leading("_recent").alias("recent_games"),
    )
    if games is not None:
        out = _with_display(staged(out), games)
    if names is not None:
        out = out.join(names.select("hash", "eco", "name"), "hash", "left")
    return out


def _with_display(report: DataFrame, games: DataFrame) -> DataFrame:
    """The listed games of a stored report with the columns of their display rows (NULL for games that have none)."""
    lists = ["top_games", "recent_games"]
    columns = [c for c in games.columns if c not in ("game_id", "ply")]

    def tagged(name: str) -> Column:
        return F.transform(name, lambda g, at: F.struct(F.lit(name).alias("list"), at.alias("at"), g.alias("g")))

    rows = report.select("hash", F.inline(F.concat(*map(tagged, lists)))).select("hash", "list", "at", "g.game_id", "g.ply")
    rows = rows.join(games.select("game_id", *columns), "game_id", "left")
    game = F.struct("at", F.struct("game_id", "ply", *columns).alias("g"))

    def of(name: str) -> Column:
        mine = F.sort_array(F.collect_list(F.when(F.col("list") == name, game)))
        return F.transform(mine, lambda r: r["g"]).alias(name)

    return report.drop(*lists).join(rows.groupBy("hash").agg(*map(of, lists)), "hash", "left")


def guard(rows: DataFrame, text: str = "epd") -> DataFrame:
    """Drop rows whose position text is not the usual one of their key (key collisions)."""
    counts = rows.groupBy("hash", text).agg(F.count(F.lit(1)).alias("_n"))
    # Ties go to the smaller text so that every run keeps the same rows.
    modal = counts.groupBy("hash").agg(F.min_by(text, F.struct(-F.col("_n"), F.col(text))).alias("_text"))
    keep = modal.select(F.col("hash"), F.col("_text").alias(text))
    return rows.join(keep, ["hash", text], "left_semi")


def opening_tree(
    rows_of: Callable[[DataFrame], DataFrame], root: DataFrame, depth: int = 2, breadth: int = 6, end=MOVE_END
) -> DataFrame:
    """The most played moves from a state, level by level.

    ``rows_of`` gives the next-step rows, with ``child``, of some states (``hash``): of a stored table those files are
    opened that can hold them (``ExplorerTable.of``). ``root`` is a frame of one ``hash``. At most breadth^level states are open;
    each level is written, so the next one starts from its few rows.
    """
    order = [F.desc("games"), F.col("move")]
    opened, out = root.select("hash"), None
    for n in range(1, depth + 1):
        best = top_k(rows_of(opened).filter(F.col("move") != end), ["hash"], order, breadth, salt="move")
        level = staged(best.select("hash", "move", "games", "rank", "child").coalesce(1))
        opened = level.where("child is not null").select(F.col("child").alias("hash")).distinct()
        rows = level.drop("child").withColumn("level", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    # A state met again on a deeper level is listed where it was met first.
    return out.groupBy("hash", "move", "games", "rank").agg(F.min("level").alias("level"))


def stats(games: DataFrame, positions: DataFrame, horizon: int, players: str = "white", others: str = "black") -> DataFrame:
    """Exact table statistics in one row."""
    names = games.select(F.lower(players).alias("n")).union(games.select(F.lower(others).alias("n")))
    counted = [
        games.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("games")),
        names.distinct().agg(F.count("n").alias("v")).withColumn("k", F.lit("players")),
        games.select(F.lower("event").alias("e")).distinct().agg(F.count("e").alias("v")).withColumn("k", F.lit("events")),
        positions.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("positions")),
    ]
    rows = counted[0]
    for c in counted[1:]:
        rows = rows.unionByName(c)
    one = rows.groupBy().agg(
        *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("games", "players", "events", "positions")]
    )
    return one.withColumn("horizon", F.lit(horizon))
