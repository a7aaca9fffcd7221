"""Registered queries of this folder: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.llm.common import fold, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SEPARATOR = 50256  # free in the rank file

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@register("op3_url_filter", """
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), urls as (
  select page_id, row_number() over () as i,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(h, p, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best as (
  select i, arg_max(h || p, length(h) * 1000 + length(p)) as rule, arg_max(verdict, length(h) * 1000 + length(p)) as verdict
  from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by i
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from urls left join best using (i)
""")
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.url_filter import judge_urls

    return judge_urls(read_table(spark, d, "pages").select("page_id", "url"), URL_RULES).drop("url")


@register("op4_byte_bpe")
def byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.byte_bpe import encode_and_decode

    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return encode_and_decode(docs, content(RANKS), public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op6_token_files")
def token_files(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(read_table(spark, d, "documents").select("doc_id", "text"), content(WORD_BPE).decode(), 1)
    return read_token_files(manifest, ids=False)


@register("op10_warc")
def warc(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.warc import page_of, read_warc, write_warc

    records = read_warc(write_warc(read_table(spark, d, "pages")), payloads=False)
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page_of("refers_to").alias("refers_to"))


@register("op2_toxicity")
def toxicity(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.toxicity import fit_toxicity, score_toxicity

    docs = read_table(spark, d, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, d, "labels")))
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op8_quality")
def quality(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.quality import fit_quality, score_quality

    docs = read_table(spark, d, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read_table(spark, d, "labels")))
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op9_vector_dedup")
def vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.vector_dedup import dedup_vectors

    return dedup_vectors(read_table(spark, d, "embeddings"))


@register("op1_token_counts")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.separators import count_tokens, write_flat_tokens

    docs = read_table(spark, d, "documents").select("doc_id", "text")
    listed = write_flat_tokens(docs, content(RANKS), public_tokenizers.PATTERN, SEPARATOR)
    counted = count_tokens(listed, SEPARATOR)
    return listed.select("path", "ordinal", "doc_id").join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")


@register("op5_weighted_minhash")
def weighted_minhash(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.weighted_minhash import dedup_texts

    return dedup_texts(read_table(spark, d, "documents").select("doc_id", "text"))


@register("op7_decontaminate")
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.decontaminate import find_leaks

    return find_leaks(read_table(spark, d, "documents").select("doc_id", "text"), read_table(spark, d, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """In texts whose id has a crc32 divisible by ten, the words from one place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    cut = cut.select("*", F.size("words").cast("long").alias("n"))
    cut = cut.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    cut = cut.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))

    def word(i):
        source = F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
        return F.get("words", source.cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.periodic_runs import find_runs, strongest

    found = find_runs(with_planted_runs(read_table(spark, d, "documents"))).drop("text")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.select("*", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@register("op12_token_alignment")
def token_alignment(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.alignment import align_texts, judge_links, pair_counts
    from ludograph.llm.common import staged

    docs = read_table(spark, d, "documents")
    aligned = staged(align_texts(docs, content(BYTE_BPE).decode(), content(PIECE_BPE), digest=True))
    return judge_links(aligned, pair_counts(aligned)).select(
        F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"),
    )


@register("op13_pii")
def pii(spark: SparkSession, d: str) -> DataFrame:
    from ludograph.llm.pii import KINDS, find_pii, fit_pii, scan, spans_of_kind, written

    scanned = scan(read_table(spark, d, "documents"))
    found = find_pii(scanned, fit_pii(scanned))
    added = F.transform("added", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    counts = [spans_of_kind(F.col("base"), k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("key").alias("doc_id"), *counts, F.size("added").cast("long").alias("n_added"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", added)).alias("spans"),
    )
