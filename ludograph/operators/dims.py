"""Dimensions (name dictionaries) and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.functions.columns import col
from ludograph.operators.skew import numbered


def names_of(df: DataFrame, columns: list[str], seq: str) -> DataFrame:
    """(name, seq) of several name columns; columns of one row come in list order."""
    n = len(columns)
    parts = F.array(*[
        F.struct(F.col(c).alias("name"), (F.col(seq) * n + i).alias("seq")) for i, c in enumerate(columns)
    ])
    return df.select(F.inline(parts)).filter(F.col("name").isNotNull())


def build_dim(names: DataFrame, name: str = "name", seq: str = "seq", start: int = 1) -> DataFrame:
    """One id per name regardless of case, in order of first appearance; the first spelling is kept.

    ``seq`` must differ between different names. Repeats fold up before the shuffle; ids are given
    without a global sort.
    """
    first = names.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("name_key")).agg(
        F.min_by(name, seq).alias("name"), F.min(seq).alias("seq")
    )
    return numbered(first, "seq", "id", start).select("id", "name", "name_key", "seq")


def new_names(dim: DataFrame, names: DataFrame, name: str = "name", seq: str = "seq", extra: tuple[str, ...] = (), fold: bool = True) -> DataFrame:
    """(id, name, extra...) of the names that ``dim`` does not have, numbered behind its largest id by first appearance.
    With ``fold`` names are equal regardless of case; the first spelling is kept."""
    key = (lambda c: F.lower(c)) if fold else F.col
    first = names.filter(F.col(name).isNotNull()).groupBy(key(name).alias("name_key")).agg(
        F.min_by(F.struct(F.col(name).alias("name"), *extra), seq).alias("first"), F.min(seq).alias("seq")
    )
    # The stored names are cut down to those that occur: a broadcast of the batch's names, where they are few.
    seen = dim.select(key("name").alias("name_key")).join(first.select("name_key"), "name_key", "left_semi").distinct()
    fresh = numbered(first.join(seen, "name_key", "left_anti").select("first.*", "seq"), "seq", "_n", 1)
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_top"))
    # One row against all: the maximum travels as a scalar subquery, not as a join.
    more = "".join(f", {c}" for c in extra)
    return dim.sparkSession.sql(f"select (select _top from {{top}}) + _n as id, name{more} from {{fresh}}", top=top, fresh=fresh)


def extend_dim(dim: DataFrame, names: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Add unseen names behind the largest id; known names keep theirs."""
    return dim.select("id", "name").unionByName(new_names(dim, names, name, seq))


def resolve_dims(facts: DataFrame, dims: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Replace names by ids: (name column, dimension, id column) each. Unknown or NULL names give NULL."""
    out = facts
    for column, dim, target in dims:
        keys = dim.select(F.lower("name").alias("_key"), F.col("id").alias(target))
        out = out.join(keys, F.lower(F.col(column)) == F.col("_key"), "left").drop("_key", column)
    return out


def opening_dim(df: DataFrame, seq: str, name: str = "opening", eco: str = "opening_eco") -> DataFrame:
    """One id per opening name; the code seen first is kept."""
    known = df.filter(F.col(name).isNotNull())
    first = known.groupBy(F.col(name).alias("name")).agg(
        F.min_by(eco, seq).alias("eco"), F.min(seq).alias("seq")
    )
    return numbered(first, "seq").select("id", "eco", "name")


def fingerprint(
    parts: list[Column | str], length: Column | str, extra: list[Column | str], short: int = 20
) -> Column:
    """Duplicate key: md5 over the parts; records shorter than ``short`` also count the extra parts."""
    text = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    more = [F.coalesce(col(p).cast("string"), F.lit("")) for p in extra]
    sep = "\u0001"
    long_form = F.concat_ws(sep, *text)
    return F.md5(F.when(col(length) < short, F.concat_ws(sep, *text, *more)).otherwise(long_form))


def game_fingerprint() -> Column:
    """Players, date, result, start position and moves; short games also event and round."""
    return fingerprint(
        [F.lower("white"), F.lower("black"), "date", "result", "start_state", F.array_join("moves", ",")],
        "ply_count",
        [F.lower("event_tag"), "round_tag"],
    )


def dedupe(df: DataFrame, key: str, seq: str) -> DataFrame:
    """First row per key in ``seq`` order (``seq`` is unique).

    The winners are found by a pre-aggregated minimum and picked by ``seq``, so a key with very many
    copies neither sorts nor gathers them in one task.
    """
    winners = df.groupBy(key).agg(F.min(seq).alias(seq)).select(seq)
    return df.join(winners, seq, "left_semi")


def only_new(df: DataFrame, stored: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose key is not stored yet.

    The stored keys are first cut down to those that occur in ``df``: for a small batch that is a
    broadcast of the batch's keys over the stored column, not a shuffle of everything stored.
    """
    seen = stored.select(key).join(df.select(key).distinct(), key, "left_semi").distinct()
    return df.join(seen, key, "left_anti")
