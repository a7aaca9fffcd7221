"""Bounded training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, share: float = 0.5,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled texts to learn from: at most ``max_rows`` documents, up to a ``share`` of them with label 1: those
    with the smallest hash of their id. Held-out ids (see ``common.fold``) and null labels or texts are left out. Columns:
    text, label (double). The documents are joined once; only the chosen rows' ids are sorted."""
    known = labels.where(~fold(F.col(key)) & F.col(label).isin(0, 1)).select(key, F.col(label).cast("double").alias("label"))
    known = known.groupBy(key).agg(F.max("label").alias("label"))
    ones = int(max_rows * share)
    chosen = [
        known.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(most)
        for value, most in ((1.0, ones), (0.0, max_rows - ones))
    ]
    ids = chosen[0].unionByName(chosen[1])  # at most max_rows ids: small enough to broadcast
    texts = docs.select(F.col(key), F.col(text).alias("text")).where(F.col(text).isNotNull())
    return texts.join(F.broadcast(ids), key).select(key, "text", "label")
