"""Quarantine and ingest reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the rejected ones with theirs."""
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def samples(bad: DataFrame, order: list[str], k: int = 20) -> DataFrame:
    """The first few rejected rows for display."""
    return bad.orderBy(*order).limit(k)


def ingest_report(statuses: DataFrame, batch: str = "batch", k: int = 20) -> DataFrame:
    """Per batch: imported, duplicates, errors, warnings and up to ``k`` messages.

    ``statuses`` has (batch, seq, status, message). Messages are cut to the first k per batch before
    they are collected; a batch that holds most rows is cut per split first.
    """
    from ludograph.operators.skew import top_k

    counts = statuses.groupBy(batch).agg(*[
        F.sum((F.col("status") == s).cast("bigint")).alias(name)
        for s, name in (("ok", "imported"), ("duplicate", "duplicates"), ("error", "errors"))
    ], F.sum(F.col("warning").isNotNull().cast("bigint")).alias("warnings"))
    told = statuses.filter(F.coalesce("message", "warning").isNotNull())
    first = top_k(told, [batch], [F.col("seq")], k, salt="seq")
    texts = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", F.coalesce("message", "warning").alias("text")))),
        lambda m: m["text"],
    )
    return counts.join(first.groupBy(batch).agg(texts.alias("samples")), batch, "left")


def history(reports: DataFrame, batch: str = "batch", k: int = 50) -> DataFrame:
    """The newest reports first."""
    return reports.orderBy(F.desc(batch)).limit(k)
