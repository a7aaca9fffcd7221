"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

Features are the byte n-grams (1 to 3 bytes, letter case and marks kept) of the whole text, hashed to ``DIMS`` columns,
and in one column more the words that repeat the word before, each counted ``REPEAT`` times:
square root of the share, times the inverse document frequency over all documents, then unit length. A truncated
singular value decomposition of the labelled rows gives the latent axes. Every document is projected on them, and its cosines
with all labelled vectors are computed exactly, block by block. The ``NEIGHBOURS`` nearest vote with their cosine.

The labelled vectors (at most ``max_rows`` of ``RANK`` floats), the axes and the frequencies are of fixed size
and are broadcast. Ties between neighbours are all within one cosine and vote alike.

Null and empty texts have no features; they get the share of label 1 among the labelled rows. Repeated rows score
alike. Where the labelled rows have one label only, every score is that label; where there are none, every score is 1:
without evidence nothing is bad. Columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.llm.common import give_back, prepare, slices
from ludograph.llm.labelled import training_rows
from ludograph.llm.words import text_bytes, word_hashes

DIMS = 1 << 12
REPEAT = 10
RANK = 40
NEIGHBOURS = 15
MAX_ROWS = 3000
PIECE = 1 << 19


def counts_of(texts: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, one row a text."""
    data, offsets = text_bytes(texts, lower=False)
    out = np.zeros((len(offsets) - 1, DIMS + 1), np.float32)
    for d in range(len(out)):
        for at in range(int(offsets[d]), int(offsets[d + 1]), PIECE):
            part = data[at : min(at + PIECE + 2, int(offsets[d + 1]))].astype(np.uint32) + np.uint32(1)
            for n in (1, 2, 3):
                code = part[: len(part) - n + 1] if len(part) >= n else part[:0]
                for k in range(1, n):
                    code = code * np.uint32(0x01000193) + part[k : k + len(code)]
                code = ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
                out[d, :DIMS] += np.bincount(code[:PIECE], minlength=DIMS)
    words, first = word_hashes(texts)
    again = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    again[first[:-1][first[:-1] < len(words)]] = False
    sums = np.concatenate([[0], np.cumsum(again)])
    out[:, DIMS] = REPEAT * (sums[first[1:]] - sums[first[:-1]])
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    x = counts / np.maximum(total, 1)
    np.sqrt(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each column occurs, and the number of documents. Tasks sum what they read; the driver gets
    ``DIMS`` sums."""
    prepare(docs.sparkSession)

    def count(batches):
        total = np.zeros(DIMS + 2, np.int64)
        for batch in slices(batches, 200):
            total[:-1] += (counts_of(batch.column(0)) > 0).sum(axis=0)
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_pydict({"at": np.arange(DIMS + 2, dtype=np.int32), "n": total})

    sums = docs.select(text).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMS + 2, np.int64)
    out[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """The axes and the labelled vectors, from at most ``max_rows`` labelled documents, half of each label."""
    seen, n = document_frequencies(docs)
    idf = (1 + np.log((1 + n) / (1 + seen))).astype(np.float32)

    def count(batches):
        for batch in slices(batches, 50):
            rows = [x.tobytes() for x in counts_of(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"counts": rows, "label": batch.column("label")})

    rows = training_rows(docs, labels, "quality", max_rows).mapInArrow(count, "counts binary, label double").toArrow()
    order = pc.sort_indices(rows["counts"]).to_numpy()
    label = rows["label"].to_numpy()[order]
    if not 0 < label.sum() < len(label):
        return {"constant": float(label[0]) if len(label) else 1.0}
    counts = np.empty((len(order), DIMS + 1), np.float32)
    for row, i in zip(counts, order.tolist()):
        row[:] = np.frombuffer(rows["counts"][i].as_buffer(), np.float32)
    del rows
    x = weigh(counts, idf)
    del counts, row
    axes = _axes(x)
    near = x @ axes
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12)
    del x
    give_back()
    return {"idf": idf, "axes": axes, "near": near, "label": label.astype(np.float32)}


def _axes(x: np.ndarray, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(RANK + 8, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ np.linalg.qr(basis)[0]))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ right.T)[:, :RANK].astype(np.float32)


def vote(texts: pa.Array, model: dict) -> np.ndarray:
    """The share of label 1 among each text's nearest labelled vectors, weighted by cosine."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    x = weigh(counts_of(texts), model["idf"]) @ model["axes"]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    cosine = (x / np.maximum(size, 1e-12)) @ model["near"].T
    k = min(NEIGHBOURS, cosine.shape[1])
    best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, best, axis=1), 0)
    total = weight.sum(axis=1)
    share = (weight * model["label"][best]).sum(axis=1) / np.maximum(total, 1e-12)
    return np.where((total > 0) & (size[:, 0] > 0), np.clip(share, 0, 1), model["label"].mean()).astype(np.float64)


def quality_score(spark: SparkSession, model: dict):
    """The score as a function of a text column."""
    shared = prepare(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        out = [vote(column.slice(at, 200), shared.value) for at in range(0, len(column), 200)]
        return pd.Series(np.concatenate(out or [np.zeros(0)]))

    return score


def score_quality(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: more likely good) and ``predicted`` (1 if the score reaches the threshold)."""
    scored = docs.drop("score", "predicted").withColumn("score", quality_score(docs.sparkSession, model)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
