"""Faceted search over games: filters, display joins, sorting, paging, name suggestion.

``games`` has one row per game with names already readable (``with_names``) or as ids plus
dimension tables. Filters are plain column conditions, so range and equality filters reach the
file scan.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.functions.columns import RESULTS, col, date_bound, format_partial_date, full_moves, result_text

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class GameQuery:
    """All search fields; empty ones are ignored, as are texts that cannot be understood (logged)."""

    player: str | None = None
    player_exact: bool = False
    color: str = "any"
    opponent: str | None = None
    white: str | None = None
    black: str | None = None
    event: str | None = None
    site: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    result: str | None = None
    min_elo: int | None = None
    max_elo: int | None = None
    eco: str | None = None
    opening: str | None = None
    min_plies: int | None = None
    max_plies: int | None = None
    annotated: bool | None = None
    state: object = None
    sort: str = "id"
    order: str = "desc"
    offset: int = 0
    limit: int = 50


def contains_ci(c: Column | str, text: str) -> Column:
    """Substring without regard to case; the text is trimmed and taken literally."""
    return F.lower(col(c)).contains(text.strip().lower())


def equals_ci(c: Column | str, text: str) -> Column:
    return F.lower(col(c)) == text.strip().lower()


def player(name: str, color: str = "any", exact: bool = False) -> Column:
    match = equals_ci if exact else contains_ci
    if color in ("white", "black"):
        return match(color, name)
    return match("white", name) | match("black", name)


def opponent(name: str, color: str = "any") -> Column:
    """The other side when the player's colour is given, else either side."""
    return player(name, {"white": "black", "black": "white"}.get(color, "any"))


def date_between(first: str | None, last: str | None, c: str = "date") -> Column | None:
    """Partial bounds: the lower one is padded with 00, the upper one with 12 and 31."""
    parts = []
    if first:
        low = date_bound(first, upper=False)
        if low is None:
            log.warning("ignored date %r", first)
        else:
            parts.append(F.col(c) >= low)
    if last:
        high = date_bound(last, upper=True)
        if high is None:
            log.warning("ignored date %r", last)
        else:
            parts.append(F.col(c) <= high)
    return reduce(and_, parts) if parts else None


def result(text: str, name: str | None = None, exact: bool = False) -> Column | None:
    """An absolute result, or win/loss/draw as seen by the named player."""
    if text in RESULTS:
        return F.col("result") == RESULTS.index(text)
    if not name or text not in ("win", "loss", "draw"):
        log.warning("ignored result %r", text)
        return None
    if text == "draw":
        return F.col("result") == 3
    as_white, as_black = (1, 2) if text == "win" else (2, 1)
    return ((F.col("result") == as_white) & player(name, "white", exact)) | (
        (F.col("result") == as_black) & player(name, "black", exact)
    )


def eco(text: str) -> Column | None:
    """One code, a prefix (``B``, ``B9``) or a range (``B90-B99``)."""
    code = text.strip().upper()
    span = re.fullmatch(r"([A-E]\d\d)\s*-\s*([A-E]\d\d)", code, re.ASCII)
    if span:
        return F.col("eco").between(span[1], span[2])
    if re.fullmatch(r"[A-E]\d\d", code, re.ASCII):
        return F.col("eco") == code
    if re.fullmatch(r"[A-E]\d?", code, re.ASCII):
        return F.col("eco").startswith(code)
    log.warning("ignored eco %r", text)
    return None


def at_least(c: str, n: int) -> Column:
    return F.col(c) >= n


def at_most(c: str, n: int) -> Column:
    return F.col(c) <= n


def plies_between(low: int | None, high: int | None) -> Column | None:
    parts = [at_least("plies", low)] if low else []
    parts += [at_most("plies", high)] if high else []
    return reduce(and_, parts) if parts else None


def moves_between(low: int | None, high: int | None) -> Column | None:
    """Length in full moves: n moves are 2n-1 or 2n plies."""
    return plies_between(2 * low - 1 if low else None, 2 * high if high else None)


def annotated(yes: bool) -> Column:
    return F.col("movetext").isNotNull() if yes else F.col("movetext").isNull()


def conditions(q: GameQuery) -> list[Column]:
    """The query's filters, without the state (that one is a join)."""
    has = lambda s: bool(s and s.strip())
    name = q.player if has(q.player) else None
    out: list[Column | None] = []
    if name:
        out.append(player(name, q.color, q.player_exact))
        if has(q.opponent):
            out.append(opponent(q.opponent, q.color))
    elif has(q.opponent):
        log.warning("ignored opponent without a player")
    for field, text in (
        ("white", q.white), ("black", q.black), ("event", q.event), ("site", q.site), ("opening", q.opening),
    ):
        if has(text):
            out.append(contains_ci(field, text))
    out.append(date_between(q.date_from, q.date_to))
    if q.result:
        out.append(result(q.result, name, q.player_exact))
    if q.min_elo:
        out.append(at_least("min_elo", q.min_elo))
    if q.max_elo:
        out.append(at_most("max_elo", q.max_elo))
    if has(q.eco):
        out.append(eco(q.eco))
    out.append(plies_between(q.min_plies, q.max_plies))
    if q.annotated is not None:
        out.append(annotated(q.annotated))
    return [c for c in out if c is not None]


def reached(games: DataFrame, positions: DataFrame, state, key: str = "id") -> DataFrame:
    """Games that reached a state in any order of steps, with the ply."""
    hits = positions.filter(F.col("hash") == F.lit(state)).select(F.col("game_id").alias(key), "ply")
    return games.join(hits, key)


def matching(games: DataFrame, q: GameQuery, positions: DataFrame | None = None) -> DataFrame:
    """Every game that passes the query's filters, unsorted."""
    rows = games
    for c in conditions(q):
        rows = rows.filter(c)
    if q.state is not None:
        if positions is None:
            raise ValueError("a search by state needs the state index")
        rows = reached(rows, positions, q.state)
    return rows


# Sort key -> column.
SORT_KEYS = {
    "id": "id", "date": "date", "white": "white", "black": "black", "event": "event",
    "whiteElo": "white_elo", "blackElo": "black_elo", "elo": "min_elo", "eco": "eco", "plies": "plies",
    "result": "result",
}


def sort_columns(key: str = "id", order: str = "desc") -> list[Column]:
    """Sort columns with the id as tie-break in the same direction; an unknown key means id."""
    name = SORT_KEYS.get(key, "id")
    keyed = F.lower(name) if name in ("white", "black", "event") else F.col(name)
    columns = [F.col("id")] if name == "id" else [keyed, F.col("id")]
    return [c.asc() if order == "asc" else c.desc() for c in columns]


def sort_games(games: DataFrame, key: str = "id", order: str = "desc") -> DataFrame:
    return games.orderBy(*sort_columns(key, order))


def page(ordered: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a sorted result; 1..1000 rows. For deep pages prefer ``after``."""
    return ordered.offset(max(int(offset), 0)).limit(min(max(int(limit), 1), 1000))


def capped_count(rows: DataFrame, cap: int = 100_000) -> DataFrame:
    """Exact total up to ``cap``, else the cap and a flag; reads no further than needed."""
    n = rows.select(F.lit(1).alias("one")).limit(cap + 1).agg(F.count("one").alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("total"), (F.col("n") > cap).alias("capped"))


def after(rows: DataFrame, last_id: int, n: int = 1000, key: str = "id") -> DataFrame:
    """The next rows in id order behind ``last_id``."""
    return rows.filter(F.col(key) > last_id).orderBy(key).limit(n)


def to_rows(games: DataFrame) -> DataFrame:
    """Display shape: readable date and result, annotated flag, full moves."""
    extra = [c for c in ("ply",) if c in games.columns]
    return games.select(
        "id", "white", "black", "white_elo", "black_elo", "event", "site",
        format_partial_date("date").alias("date"),
        result_text("result").alias("result"),
        "eco", "opening", "plies", full_moves("plies").alias("moves"),
        F.col("movetext").isNotNull().alias("annotated"), *extra,
    )


def search(games: DataFrame, q: GameQuery, positions: DataFrame | None = None) -> DataFrame:
    """A page of display rows."""
    return to_rows(page(sort_games(matching(games, q, positions), q.sort, q.order), q.offset, q.limit))


# ---- search on ids ------------------------------------------------------------------------


def _flagged(rows: DataFrame, names: DataFrame, key: str, match: Column, flag: str) -> DataFrame:
    """Rows with a flag that says whether the id in ``key`` is of a matching name. Only matching ids travel."""
    hits = names.filter(match).select(F.col("id").alias("_id"), F.lit(True).alias(flag))
    out = rows.join(hits, F.col(key) == F.col("_id"), "left").drop("_id")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def matching_star(star, q: GameQuery, hits: DataFrame | None = None) -> DataFrame:
    """Games (with ids) that pass the query's filters: conditions on numbers first, then names by their dictionaries.

    ``hits`` are the index rows of the query's state. No name of a game is looked up.
    """
    has = lambda s: bool(s and s.strip())
    name = q.player if has(q.player) else None
    relative = q.result if q.result in ("win", "loss") else None
    own = replace(q, player=None, opponent=None, white=None, black=None, event=None, site=None, opening=None,
                  result=None if relative else q.result)
    rows = star.games
    for c in conditions(own) if q.result != "draw" else [*conditions(replace(own, result=None)), *([F.col("result") == 3] if name else [])]:
        rows = rows.filter(c)
    if q.state is not None:
        if hits is None:
            raise ValueError("a search by state needs its index rows")
        rows = rows.join(hits.select(F.col("game_id").alias("id"), "ply"), "id")
    if name:
        match = equals_ci("name", name) if q.player_exact else contains_ci("name", name)
        rows = _flagged(_flagged(rows, star.players, "white_id", match, "_w"), star.players, "black_id", match, "_b")
        side = {"white": F.col("_w"), "black": F.col("_b")}.get(q.color, F.col("_w") | F.col("_b"))
        if relative:
            as_white, as_black = (1, 2) if relative == "win" else (2, 1)
            side = side & (((F.col("result") == as_white) & F.col("_w")) | ((F.col("result") == as_black) & F.col("_b")))
        rows = rows.filter(side).drop("_w", "_b")
        if has(q.opponent):
            other = contains_ci("name", q.opponent)
            rows = _flagged(_flagged(rows, star.players, "white_id", other, "_w"), star.players, "black_id", other, "_b")
            rows = rows.filter({"white": F.col("_b"), "black": F.col("_w")}.get(q.color, F.col("_w") | F.col("_b"))).drop("_w", "_b")
    elif has(q.opponent):
        log.warning("ignored opponent without a player")
    for names, key, text in ((star.players, "white_id", q.white), (star.players, "black_id", q.black), (star.events, "event_id", q.event),
                             (star.sites, "site_id", q.site), (star.openings, "opening_id", q.opening)):
        if has(text):
            rows = semi(rows, names, [key], contains_ci("name", text))
    return rows


def search_star(star, q: GameQuery, hits: DataFrame | None = None) -> DataFrame:
    """A page of display rows. The page is cut on ids; a sort by name looks up that one name, and all other names are
    joined to the rows of the page only."""
    rows = matching_star(star, q, hits)
    name = SORT_KEYS.get(q.sort, "id")
    by = {"white": ("white_id", star.players), "black": ("black_id", star.players), "event": ("event_id", star.events)}.get(name)
    if by:
        key, names = by
        rows = rows.join(names.select(F.col("id").alias(key), F.lower("name").alias("_sort")), key, "left")
        columns = ["_sort", "id"]
    else:
        columns = ["id"] if name == "id" else [name, "id"]
    order = [F.asc(c) if q.order == "asc" else F.desc(c) for c in columns]
    cut = page(rows.orderBy(*order), q.offset, q.limit).drop("_sort")
    named = with_names(cut, star.players, star.events, star.sites, star.openings)
    return to_rows(sort_games(named, q.sort, q.order))


def get_game(games: DataFrame, game_id: int) -> DataFrame:
    return games.filter(F.col("id") == game_id)


# ---- joins ------------------------------------------------------------------------------


def with_names(games: DataFrame, players: DataFrame, events: DataFrame, sites: DataFrame, openings: DataFrame) -> DataFrame:
    """Replace ids by names: both players must exist, event, site and opening may be missing.

    Apply after paging where possible. No broadcast hints: dimensions can grow, so the engine
    decides by measured size.
    """
    def dim(d: DataFrame, key: str, name: str) -> DataFrame:
        return d.select(F.col("id").alias(key), F.col("name").alias(name))

    out = games.join(dim(players, "white_id", "white"), "white_id")
    out = out.join(dim(players, "black_id", "black"), "black_id")
    out = out.join(dim(events, "event_id", "event"), "event_id", "left")
    out = out.join(dim(sites, "site_id", "site"), "site_id", "left")
    out = out.join(dim(openings, "opening_id", "opening"), "opening_id", "left")
    return out.drop("white_id", "black_id", "event_id", "site_id", "opening_id")


def semi(games: DataFrame, dim: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Games whose id column(s) point at a dimension row that passes ``condition``.

    Several keys mean "any of them": the distinct hits are looked up by each key, and games are read once.
    """
    hits = dim.filter(condition).select(F.col("id").alias("_id")).distinct()
    if len(keys) == 1:
        return games.join(hits, F.col(keys[0]) == F.col("_id"), "left_semi")
    out = games
    for i, k in enumerate(keys):
        hit = hits.select(F.col("_id").alias(f"_id{i}"))
        out = out.join(hit, F.col(k) == F.col(f"_id{i}"), "left")
    return out.filter(F.coalesce(*[F.col(f"_id{i}") for i in range(len(keys))]).isNotNull()).select(*games.columns)


def in_order(refs: DataFrame, rows: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Rows in the order of a reference list; unknown ids drop out."""
    return refs.select(key, pos).join(rows, key).orderBy(pos)


def suggest(names: DataFrame, text: str, k: int = 15, name: str = "name") -> DataFrame:
    """Names for a typed text: those that start with it first, then those that contain it."""
    typed = text.strip().lower()
    if not typed:
        return names.select(name).limit(0)
    found = names.filter(F.lower(name).contains(typed)).select(
        name, F.when(F.lower(name).startswith(typed), 0).otherwise(1).alias("rank")
    ).distinct()
    return found.orderBy("rank", F.lower(name), name).limit(k)
