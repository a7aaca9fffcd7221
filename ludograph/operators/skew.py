"""Helpers that keep hot keys from landing in one task.

Hot keys are found by a pre-aggregated count: all keys with more than ``min_rows`` rows, so the
ordinary path never windows a longer sequence. Their list is joined by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, by: list[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more than ``min_rows`` rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows).select(*by)


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    *,
    bucket: Column | None = None,
    sums: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    hot: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running values over ordered sequences: what lies strictly before each row, and the next row.

    ``sums`` and ``xors`` give the total over the preceding rows (0 at the start), ``latest`` the last
    value before the row that is not NULL, ``following`` the value of the next row. ``bucket`` is an integer that never decreases along ``order``; sequences
    with more than ``min_rows`` rows are cut at its changes, worked on piece by piece, and joined up
    through the pieces' totals. ``hot`` are the keys to split, where the caller has counted them already
    (in one pass for several calls). Without ``bucket`` a sequence must be bounded by nature (one record).
    """
    sums, xors, following, latest = sums or {}, xors or {}, following or {}, latest or {}
    values = {**{f"_s_{k}": v for k, v in sums.items()}, **{f"_x_{k}": v for k, v in xors.items()}}
    values |= {f"_f_{k}": F.struct(v.alias("v")) for k, v in following.items()}
    values |= {f"_l_{k}": v for k, v in latest.items()}
    work = df.select("*", *[v.alias(k) for k, v in values.items()])
    part = list(by)
    if bucket is not None:
        keys = hot_keys(df, by, min_rows) if hot is None else hot
        work = work.join(keys.withColumn("_hot", F.lit(True)), by, "left")
        work = work.withColumn("_bucket", F.when(F.col("_hot"), bucket.cast("bigint"))).drop("_hot")
        part.append("_bucket")
    ordered = Window.partitionBy(*part).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    inner = work.select(
        *df.columns,
        *([F.col("_bucket")] if bucket is not None else []),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), zero).alias(k) for k in sums],
        *[F.coalesce(F.bit_xor(f"_x_{k}").over(before), zero).alias(k) for k in xors],
        *[F.last(f"_l_{k}", ignorenulls=True).over(before).alias(k) for k in latest],
        *[F.lead(f"_f_{k}").over(ordered).alias(f"_f_{k}") for k in following],
    )
    if bucket is None:
        return inner.select(
            *df.columns, *sums, *xors, *latest, *[F.col(f"_f_{k}")["v"].alias(k) for k in following]
        )
    pieces = work.filter(F.col("_bucket").isNotNull()).groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums],
        *[F.bit_xor(f"_x_{k}").alias(f"_x_{k}") for k in xors],
        *[
            F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.struct(*order))).alias(f"_l_{k}")
            for k in latest
        ],
        *[F.min_by(f"_f_{k}", F.struct(*order)).alias(f"_f_{k}") for k in following],
    )
    along = Window.partitionBy(*by).orderBy("_bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *part,
        *[F.sum(f"_s_{k}").over(earlier).alias(f"_os_{k}") for k in sums],
        *[F.bit_xor(f"_x_{k}").over(earlier).alias(f"_ox_{k}") for k in xors],
        *[F.last(f"_l_{k}", ignorenulls=True).over(earlier).alias(f"_ol_{k}") for k in latest],
        *[F.lead(f"_f_{k}").over(along).alias(f"_of_{k}") for k in following],
    )
    joined = inner.join(offsets, part, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(k) + F.coalesce(F.col(f"_os_{k}"), zero)).alias(k) for k in sums],
        *[F.col(k).bitwiseXOR(F.coalesce(F.col(f"_ox_{k}"), zero)).alias(k) for k in xors],
        *[F.coalesce(F.col(k), F.col(f"_ol_{k}")).alias(k) for k in latest],
        *[F.coalesce(F.col(f"_f_{k}"), F.col(f"_of_{k}"))["v"].alias(k) for k in following],
    )


def numbered(df: DataFrame, seq: str, name: str = "id", start: int = 1, width: int = 65_536) -> DataFrame:
    """``row_number() over (order by seq)`` without one task seeing all rows.

    ``seq`` is a unique non-negative integer. Rows are counted per block of ``width`` values; only the
    block totals (one row per block) are put in order in one place.
    """
    block = F.floor(F.col(seq) / width)
    tagged = df.withColumn("_block", block)
    totals = tagged.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(seq)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_block")
        .withColumn(name, (F.col("_offset") + F.col("_rn") + (start - 1)).cast("bigint"))
        .drop("_block", "_rn", "_offset")
    )


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, *, salt: str, rank: str = "rank", salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of every group. Groups are split by ``salt`` first, so a group that holds
    most rows is cut down to ``k`` per split (and per map task) before it comes together."""
    split = F.pmod(F.xxhash64(salt), F.lit(salts))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", split)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= k)
        .drop("_salt", "_rn")
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= k)
    )


def largest(value: Column, k: int) -> Column:
    """Aggregate: the ``k`` largest values, the largest first, NULL fields last. Its state holds ``k`` values and merges, so
    hot groups shrink before the shuffle."""
    return InternalFunction.collect_top_k(value, max(k, 1), False)
