"""Corpus preparation: good, harmless, distinct and uncontaminated documents as tokens.

Each stage takes all rows that its predecessor kept, with all their columns, and its decisions take effect. Results are
written as Parquet and read again between stages. Null and empty texts, repeated rows, empty tables and further columns
are treated as each operator's docstring says: a stage never drops a document without a reason of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.llm.byte_bpe import encode_and_decode
from ludograph.llm.common import among, read_table, spare, staged
from ludograph.llm.decontaminate import without_leaks
from ludograph.llm.quality import fit_quality, quality_score
from ludograph.llm.queries import RANKS, content
from ludograph.llm.toxicity import fit_toxicity, toxicity_score
from ludograph.llm.weighted_minhash import dedup_texts

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them (score 0.3 or more)."""
    score = quality_score(spark, fit_quality(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    score = toxicity_score(spark, fit_toxicity(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id; of rows that repeat id and text, one."""
    groups = dedup_texts(docs.select("doc_id", "text"), hashed=True)
    own = [f"`{c}`" for c in docs.columns]
    tx = spare("tx", *docs.columns)
    copies = staged(groups.where(~F.col("kept")).select("doc_id", F.col("tx").alias(tx)).distinct())
    rest = among(docs.withColumn(tx, F.xxhash64("text")), copies, ["doc_id", tx])[1].select(own)
    again = docs.where("doc_id is not null and text is not null").groupBy("doc_id", F.xxhash64("text").alias("tx"))
    again = staged(again.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").distinct())
    if again.isEmpty():
        return rest
    some, others = among(rest, again, ["doc_id"])
    return others.unionByName(some.dropDuplicates(["doc_id", "text"]))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number and hash, and the hash of the bytes they decode to."""
    coded = encode_and_decode(docs.select("doc_id", "text"), content(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("minhash near-dedup", near_distinct),
    ("benchmark decontamination", uncontaminated),
    ("byte-level bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
