"""Toxicity: averaged subword vectors under a linear softmax, trained jointly in numpy.

A text is the bag of the byte n-grams (``GRAMS``) of its lower-case bytes, words and blanks alike, hashed to
``BUCKETS`` vectors. Their mean (with ``PRIOR`` zero vectors, so that few n-grams
weigh less) goes into a softmax over two labels; vectors and weights are learnt together by
Adagrad. An unseen misspelling shares most n-grams with words seen in training, and so their vectors.

After training, a document's logit is the mean over its n-grams of one number a bucket, so scoring sends the workers only
that table (``BUCKETS`` floats) and is a vectorised sum over whole texts; long texts are summed in pieces.

Null and empty texts have no n-gram and get the score of the bias. Repeated rows score alike. Where the labelled rows have
one label only, every score is that label; where there are none, every score is 0: without evidence nothing is toxic. Columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.llm.common import give_back, new_folder, open_file, prepare, slices
from ludograph.llm.labelled import training_rows
from ludograph.llm.words import text_bytes

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
PRIOR = 200
MAX_ROWS = 3000
TOXIC_SHARE = 0.3
PIECE = 1 << 19


def buckets_of(data: np.ndarray) -> list[np.ndarray]:
    """For each n of ``GRAMS``, the bucket of the n-gram that starts at each byte."""
    out, code = [], data.astype(np.uint32) + np.uint32(1)
    for n in range(2, max(GRAMS) + 1):
        if len(code) < 2:
            out += [np.zeros(0, np.intp)] * (n in GRAMS)
            continue
        code = code[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in GRAMS:
            spread = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append((spread >> np.uint32(14)).astype(np.intp) & (BUCKETS - 1))
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and their shares of its n-grams."""
    data, _ = text_bytes(pa.array([text], pa.string()))
    parts = [np.zeros(0, np.intp)]
    for at in range(0, len(data), PIECE):
        for n, found in zip(GRAMS, buckets_of(data[at : at + PIECE + max(GRAMS) - 1])):
            parts.append(found[: max(0, min(PIECE, len(data) - at - n + 1))])
    used, counts = np.unique(np.concatenate(parts), return_counts=True)
    return used.astype(np.int32), (counts / (counts.sum() + PRIOR)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 12, steps: int = 500, rate: float = 0.5,
          batch: int = 50, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn vectors and softmax from batches of which a fifth has label 1; returns the number of each bucket, and the
    bias, of the difference of the logits."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    weights, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    sum_v, sum_w, sum_b = (np.full(x.shape, 1e-8, np.float32) for x in (vectors, weights, bias))
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    toxic, other = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    place = np.zeros(BUCKETS, np.int64)
    for _ in range(steps):
        rows = np.concatenate([rng.choice(toxic, batch // 5), rng.choice(other, batch - batch // 5)])
        used = np.concatenate([bags[i][0] for i in rows])
        owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
        touched = np.flatnonzero(np.bincount(used, minlength=BUCKETS))
        place[touched] = np.arange(len(touched))
        bag = np.zeros((len(rows), len(touched)), np.float32)
        bag[owner, place[used]] = np.concatenate([bags[i][1] for i in rows])
        local = vectors[touched]
        mean = bag @ local
        logit = mean @ weights + bias
        odds = np.exp(logit - logit.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
        grad_w, grad_b, grad_v = mean.T @ error, error.sum(axis=0), bag.T @ (error @ weights.T)
        sum_w += grad_w**2
        sum_b += grad_b**2
        weights -= rate * grad_w / np.sqrt(sum_w)
        bias -= rate * grad_b / np.sqrt(sum_b)
        moved = sum_v[touched] + grad_v**2
        sum_v[touched] = moved
        vectors[touched] = local - rate * grad_v / np.sqrt(moved)
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def write_bags(rows: DataFrame) -> DataFrame:
    """Write the bag of each row's ``text`` to files of the shared folder, one a task: its buckets, then their shares.
    Columns: path, at (the place in the file), n (buckets) and the row's label."""
    folder = new_folder(prepare(rows.sparkSession), "bags")

    def write(batches):
        out, at, path = None, 0, f"{folder}/{uuid.uuid4().hex}.bags"
        for batch in slices(batches, 50):
            places, sizes = [], []
            for text in batch.column("text").to_pylist():
                used, share = features(text)
                data = used.tobytes() + share.astype(np.float16).tobytes()
                out = out or open_file(path, "w")
                out.write(data + bytes(-len(data) % 4))
                places.append(at)
                sizes.append(len(used))
                at += len(data) + -len(data) % 4
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(places), pa.string()), pa.array(places, pa.int64()),
                                              pa.array(sizes, pa.int64()), batch.column("label")], names=["path", "at", "n", "label"])
        if out:
            out.close()

    return rows.select("text", "label").mapInArrow(write, "path string, at long, n long, label double")


def read_bags(listed: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags of listed rows, as views of a local file of the driver that the system maps: only what a step of the
    training looks at need be in memory."""
    starts, end = {}, 4
    with tempfile.TemporaryFile() as local:
        local.write(bytes(end))  # a file without bytes cannot be mapped
        for path in sorted(set(listed["path"].to_pylist())):
            with open_file(path) as file:
                shutil.copyfileobj(file, local, 1 << 20)
            starts[path], end = end, local.tell()
        local.flush()
        data = np.memmap(local, np.uint8, "r")
    out = []
    for path, at, n in zip(*(listed[c].to_pylist() for c in ("path", "at", "n"))):
        at += starts[path]
        out.append((np.frombuffer(data, np.int32, n, at), np.frombuffer(data, np.float16, n, at + 4 * n)))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Train on at most ``max_rows`` labelled documents, up to ``TOXIC_SHARE`` of them toxic. Tasks write their bags (of at most
    ``BUCKETS`` entries) to files; the driver gets a short row of each and holds the bags of one step."""
    rows = write_bags(training_rows(docs, labels, "toxic", max_rows, TOXIC_SHARE)).toArrow()
    label = rows["label"].to_numpy()
    if not 0 < label.sum() < len(label):
        return np.zeros(BUCKETS, np.float32), 50.0 if label.sum() else -50.0
    found = read_bags(rows)  # taken in an order that does not depend on the tasks' order
    order = sorted(range(len(found)), key=lambda i: (label[i], len(found[i][0]), zlib.crc32(found[i][0]), zlib.crc32(found[i][1])))
    model = train([found[i] for i in order], label[order])
    give_back()
    return model


def logits(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The mean of the table over each text's n-grams, plus the bias."""
    data, offsets = text_bytes(texts)
    sums = np.zeros(len(offsets) - 1)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + max(GRAMS) - 1]
        for n, found in zip(GRAMS, buckets_of(part)):
            value = np.concatenate([[0.0], np.cumsum(table[found[:PIECE]], dtype=np.float64)])
            first = np.clip(offsets[:-1] - at, 0, len(value) - 1)
            last = np.clip(offsets[1:] - n + 1 - at, first, len(value) - 1)
            sums += value[last] - value[first]
    grams = sum(np.maximum(np.diff(offsets) - n + 1, 0) for n in GRAMS)
    return sums / (grams + PRIOR) + bias


def toxicity_score(spark: SparkSession, model: tuple[np.ndarray, float]):
    """The score as a function of a text column."""
    shared = prepare(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        out = [logits(column.slice(at, 200), *shared.value) for at in range(0, len(column), 200)]
        return pd.Series(1 / (1 + np.exp(-np.concatenate(out or [np.zeros(0)]))))

    return score


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` (1 if the score is 0.5 or more)."""
    scored = docs.drop("score", "predicted").withColumn("score", toxicity_score(docs.sparkSession, model)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
