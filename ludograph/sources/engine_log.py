"""Engine log lines -> evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_engine_log(
    df: DataFrame, by: list[str], line: str = "line", seq: str = "seq", turn: str = "turn"
) -> DataFrame:
    """Latest complete ``info`` line per position and line number, scored from White's view.

    Lines without score or moves, and bound lines, do not count. The last complete line is found by
    a pre-aggregated maximum, so a position with a very long log stays cheap. Moves stay as written.
    """
    text = F.regexp_replace(line, r" string .*$", "")

    def number(name: str):
        return F.nullif(F.regexp_extract(text, rf" {name} (-?\d+)", 1), F.lit("")).try_cast("int")

    kind = F.regexp_extract(text, r" score (cp|mate) (-?\d+)", 1)
    value = F.nullif(F.regexp_extract(text, r" score (cp|mate) (-?\d+)", 2), F.lit("")).try_cast("int")
    value = F.when(F.col(turn) == "b", -value).otherwise(value)
    moves = F.split(F.trim(F.regexp_extract(text, r" pv (.+)$", 1)), " +")
    rows = df.filter(F.col(line).startswith("info ")).select(
        *by, seq,
        F.coalesce(number("multipv"), F.lit(1)).alias("multipv"),
        F.coalesce(number("depth"), F.lit(0)).alias("depth"),
        F.when(kind == "cp", value).alias("cp"),
        F.when(kind == "mate", value).alias("mate"),
        moves.alias("pv"),
        text.rlike(r" score (?:cp|mate) -?\d+ (?:lower|upper)bound").alias("bound"),
    )
    whole = rows.filter((F.col("cp").isNotNull() | F.col("mate").isNotNull()) & (F.get("pv", F.lit(0)) != "") & ~F.col("bound"))
    last = F.max_by(F.struct("depth", "cp", "mate", "pv"), F.col(seq)).alias("l")
    return whole.groupBy(*by, "multipv").agg(last).select(
        *by, "multipv", "l.depth", "l.cp", "l.mate", F.get("l.pv", F.lit(0)).alias("best"), "l.pv"
    )
