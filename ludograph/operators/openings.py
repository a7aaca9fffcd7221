"""Naming states from a reference table (eco, name, hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.operators.skew import HOT_ROWS, running


def build_openings(lines: DataFrame) -> DataFrame:
    """Lines (eco, name, hash of their last state, plies) -> one name per state, by the shortest line."""
    first = F.min_by(F.struct("eco", "name"), F.struct("plies", "name", "eco")).alias("o")
    return lines.groupBy("hash").agg(first, F.min("plies").alias("plies")).select("hash", "o.eco", "o.name", "plies")


def name_states(df: DataFrame, ref: DataFrame, state: str = "hash") -> DataFrame:
    """Exact name of each state, NULL where it has none."""
    names = ref.select(F.col("hash").alias(state), "eco", "name")
    return df.join(names, state, "left")


def classify(plies: DataFrame, ref: DataFrame, by: list[str], *, deepest: int = 40, standard: Column | None = None) -> DataFrame:
    """Deepest named state of each game among plies 1..deepest.

    ``standard`` tells games from the usual start; others are not classified. The join keeps only
    named states, so little is left to shuffle by game.
    """
    rows = plies if standard is None else plies.filter(standard)
    named = rows.filter(F.col("ply").between(1, deepest)).select(*by, "ply", "hash").join(
        ref.select("hash", "eco", "name"), "hash"
    )
    last = F.max_by(F.struct("eco", "name"), F.col("ply")).alias("o")
    return named.groupBy(*by).agg(last, F.max("ply").alias("named_ply")).select(
        *by, F.col("o.eco").alias("opening_eco"), F.col("o.name").alias("opening"), "named_ply"
    )


def nearest_named(
    plies: DataFrame, ref: DataFrame, by: list[str], order: list[str], *, bucket: Column | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Name of each state, or of the nearest named state before it on the same path.

    The name travels along the path as the latest value seen (see ``running`` for long paths).
    """
    named = name_states(plies, ref)
    here = F.when(F.col("name").isNotNull(), F.struct("eco", "name"))
    out = running(named, by, order, bucket=bucket, latest={"_near": here}, min_rows=min_rows)
    near = F.coalesce(here, F.col("_near"))
    return out.select(
        *plies.columns, near["eco"].alias("near_eco"), near["name"].alias("near_name")
    )
