"""Sequences of steps -> states, next steps, first visits, and the state index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.functions.columns import MOVE_END
from ludograph.functions.hashing import text_key
from ludograph.operators.skew import HOT_ROWS, hot_keys, running


def states(
    df: DataFrame, by: list[str], order: list[str], step: str, *, mode: str = "bag",
    vocabulary: list[str] | None = None, bucket: Column | None = None, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the steps of every sequence (``ply``) and key the state before each one (``state``).

    ``bag``  order-free: counts of each step so far. With a ``vocabulary`` the state is readable text
             (``2|0|1``), else a sum of 36-bit step keys.
    ``path`` the exact steps so far: exclusive-or of one key per (ply, step).
    Rows keep their columns. See ``running`` for ``bucket``.
    """
    if mode == "path":
        hot = None if bucket is None else hot_keys(df, by, min_rows)
        plies = running(df, by, order, bucket=bucket, sums={"ply": F.lit(1)}, hot=hot)
        key = text_key(F.concat_ws("|", F.col("ply").cast("string"), F.col(step)))
        return running(plies, by, order, bucket=bucket, xors={"state": key}, hot=hot)
    sums: dict[str, Column] = {"ply": F.lit(1)}
    if vocabulary is None:
        sums["state"] = text_key(F.col(step), 9)
        return running(df, by, order, bucket=bucket, sums=sums, min_rows=min_rows)
    counts = [f"_c{i}" for i in range(len(vocabulary))]
    for name, word in zip(counts, vocabulary):
        sums[name] = (F.col(step) == word).cast("bigint")
    out = running(df, by, order, bucket=bucket, sums=sums, min_rows=min_rows)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in counts])
    return out.withColumn("state", text).drop(*counts)


def with_next(
    df: DataFrame, by: list[str], order: list[str], step: str, *, end=MOVE_END, name: str = "next",
    bucket: Column | None = None, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """The step taken after this row, or the end marker. (For rows that hold the step *into* a state.)"""
    out = running(df, by, order, bucket=bucket, following={name: F.col(step)}, min_rows=min_rows)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(end)))


def with_final(plies: DataFrame, by: list[str], step: str, final: DataFrame, end=MOVE_END) -> DataFrame:
    """Add one row per sequence for its last state, whose next step is the end marker."""
    return plies.unionByName(final.withColumn(step, F.lit(end)))


def horizon(df: DataFrame, n: int = 60, ply: str = "ply") -> DataFrame:
    """Keep states 0..n. Apply after the next step is known: the step from state n stays."""
    if not 0 <= n <= 400:
        raise ValueError("the horizon must lie in 0..400")
    return df.filter(F.col(ply) <= n)


def with_child(plies: DataFrame, by: list[str], n: int = 60, state: str = "hash", ply: str = "ply", name: str = "child") -> DataFrame:
    """States 0..n of each sequence with the state that the step leads to (NULL behind the last). Sequences are cut at n + 1
    first, so none is long."""
    rows = running(df=plies.filter(F.col(ply) <= n + 1), by=by, order=[ply], following={name: F.col(state)})
    return horizon(rows, n, ply)


def first_visit(df: DataFrame, by: list[str], state: str = "hash", ply: str = "ply", keep: list[str] | None = None) -> DataFrame:
    """One row per (sequence, state): its first occurrence, with that row's other columns."""
    keep = keep if keep is not None else [c for c in df.columns if c not in {*by, state, ply}]
    first = F.min_by(F.struct(ply, *keep), F.col(ply)).alias("_first")
    return df.groupBy(*by, state).agg(first).select(*by, state, "_first.*")


def position_index(plies: DataFrame, games: DataFrame, key: str = "game_id") -> DataFrame:
    """State rows with outcome, mean rating and year of their game.

    ``plies`` holds (game, hash, move, ply), and ``child`` if it is known, after ``horizon`` and ``first_visit``. An ordinary
    equi-join on the game: the engine broadcasts, sorts or splits hot games by measured sizes.
    """
    facts = games.select(key, "result", "elo", "year")
    child = ["child"] if "child" in plies.columns else []
    return plies.join(facts, key).select("hash", "move", key, "ply", "result", "elo", "year", *child)


PIECE = 1024


def pack(df: DataFrame, by: list[str], value: str, ply: str = "ply", name: str = "moves") -> DataFrame:
    """Steps of each record in ordered arrays, one for each ``piece`` of ``PIECE`` plies, so that no list grows
    with its record."""
    rows = F.array_sort(F.collect_list(F.struct(ply, value)))
    piece = F.floor(F.col(ply) / PIECE).cast("int").alias("piece")
    return df.groupBy(*by, piece).agg(F.transform(rows, lambda r: r[value]).alias(name))


def unpack(df: DataFrame, array: str = "moves", value: str = "move", ply: str = "ply") -> DataFrame:
    rest = [c for c in df.columns if c not in (array, "piece")]
    rows = df.select(*rest, "piece", F.posexplode(array).alias(ply, value))
    return rows.withColumn(ply, F.col(ply) + F.col("piece") * PIECE).select(*rest, ply, value)


def step_hash(df: DataFrame, by: list[str], key: str, name: str = "hash") -> DataFrame:
    """Key of a whole sequence (or exploded placement): exclusive-or of its rows' keys."""
    return df.groupBy(*by).agg(F.bit_xor(key).alias(name))


def validate(
    tags: Column, start_state: Column, n_moves: Column
) -> Column:
    """NULL for a usable record, else why it is rejected.

    Checked: the variant, the shape of a given start position (fields, ranks, kings, pawns, side,
    castling, en-passant square) and that there are tags or moves at all. A king left in check is
    found by the replay job.
    """
    variant = F.lower(F.element_at(tags, "Variant"))
    fields = F.split(F.regexp_replace(start_state, r"^\s+|\s+$", ""), r"\s+")
    board = F.split(F.get(fields, F.lit(0)), "/")
    widths = F.transform(board, lambda r: F.length(_spread(r)))
    odd = F.exists(board, lambda r: ~r.rlike("^[pnbrqkPNBRQK1-8]+$"))
    whole = F.array_join(board, "")
    ends = F.concat(F.coalesce(F.get(board, F.lit(0)), F.lit("")), F.coalesce(F.get(board, F.lit(7)), F.lit("")))
    bad = (
        (F.size(fields) < 4)
        | (F.size(board) != 8)
        | odd
        | F.exists(widths, lambda n: n != 8)
        | (F.length(F.regexp_replace(whole, "[^K]", "")) != 1)
        | (F.length(F.regexp_replace(whole, "[^k]", "")) != 1)
        | ends.rlike("[pP]")
        | ~F.coalesce(F.get(fields, F.lit(1)), F.lit("")).isin("w", "b")
        | ~F.coalesce(F.get(fields, F.lit(2)), F.lit("")).rlike("^(?:-|[KQkqHAha]+)$")
        | ~F.coalesce(F.get(fields, F.lit(3)), F.lit("")).rlike("^(?:-|[a-h][1-8])$")
    )
    return (
        F.when((F.size(tags) == 0) & (n_moves == 0), "not a game: no tags and no moves")
        .when(
            variant.isNotNull() & ~variant.isin("", "standard", "from position", "chess"),
            F.concat(F.lit("unsupported variant "), variant),
        )
        .when(start_state.isNotNull() & bad, "invalid start position")
    )


def _spread(rank: Column) -> Column:
    for n in range(8, 0, -1):
        rank = F.replace(rank, F.lit(str(n)), F.lit("." * n))
    return rank
