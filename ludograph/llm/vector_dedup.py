"""Near duplicates among vectors by a pivot-permutation index.

Pivots are vectors of a bounded sample, chosen far apart. Each vector is described by its ``nearest`` pivots in the order
of their distance. The inverted lists are kept by ``shared`` pivots at a time: a vector stands in the list of every
combination of that many of its nearest pivots, so exactly the pairs that share at least that many meet. In a list,
pairs are counted where they meet first (the combination of their lowest common pivots), their cosine is computed
in double precision in blocks, and only sums and local roots leave the task, never the pairs.

Lists longer than ``CHUNK`` are cut into chunks, and every two chunks of a list make one unit of work, so no task holds
a long list; all pairs of a list are compared. Equal vectors are one entry with a count. Vectors are indexed all; recall against brute
force is measured in the tests (over 0.99 of the links on the given tables).

Only vectors of equal labels (and lengths) are compared. Null labels or ids, null and zero vectors, and vectors with
null or non-finite components link with nothing. Each row counts as a vector of its own, also if its id is repeated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import local_roots, prepare, staged
from ludograph.llm.components import components

PIVOTS = 64
SAMPLE = 2000
CHUNK = 800


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Unit vectors far apart: each next one has the least cosine with its nearest chosen one."""
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(pivots, len(units)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def permutations(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The places of the nearest pivots of each vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)


def _lowest(bits: np.ndarray, count: int) -> np.ndarray:
    """Only the lowest ``count`` set bits of each number."""
    rest = bits
    for _ in range(count):
        rest = rest & (rest - np.uint64(1))
    return bits ^ rest


def _links(ids: np.ndarray, copies: np.ndarray, masks: np.ndarray, units: np.ndarray, left: np.ndarray | None, key: np.uint64,
           shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that have links counted in this list, the number of vectors they link with, and their local roots."""
    link = (units @ units.T) >= threshold
    link &= _lowest(masks[:, None] & masks[None, :], shared) == key
    np.fill_diagonal(link, False)
    if left is not None:  # two chunks of a long list: only pairs across
        link &= left[:, None] != left[None, :]
    counts = link @ copies
    linked, root = local_roots(ids, link)
    return ids[linked], counts[linked], root


def dedup_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
                  nearest: int = 6, shared: int = 3, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """One row a vector: ``key``, ``n_links`` (other vectors with a cosine of at least the threshold), ``component_id``
    (the least id reachable) and ``kept`` (that id is its own)."""
    if not shared <= nearest <= pivots <= 64:
        raise ValueError("shared <= nearest <= pivots <= 64 is needed")
    spark = prepare(df.sparkSession)
    part: Column = F.struct(F.col(label).alias("label"), F.size(vector).alias("size"))
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(
        F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0), F.lit(False))
    marked = df.select(F.col(key).alias("id"), part.alias("part"), F.col(vector).alias("vector"), fine.alias("fine"),
                       F.xxhash64(label, vector).alias("k1"), F.xxhash64(F.lit(1), vector, label).alias("k2"))
    distinct = staged(marked.where("fine").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("part").alias("part"), F.first("vector").alias("vector")))
    group = F.xxhash64("part")

    # The sample is bounded, so are the pivots: one set for all labels, of each length of vectors.
    rows = distinct.orderBy("k1", "k2").limit(sample).select("vector").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.vector), []).append(r.vector)
    shared_pivots = spark.sparkContext.broadcast({n: choose_pivots(np.array(v, dtype=np.float64), pivots) for n, v in by_size.items()})

    def index(batches):
        for batch in batches:
            out = {"list": [], "mask": [], "unit": []}
            take = []
            for i, v in enumerate(batch.column("vector").to_pylist()):
                x = np.array(v, dtype=np.float64)
                x /= np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max()
                points = shared_pivots.value.get(len(x), np.eye(1, len(x)))  # a length outside the sample: one list
                order = permutations(x[None], points, nearest)[0]
                mask = int(sum(1 << int(p) for p in order))
                for c in combinations(sorted(order.tolist()), min(shared, len(order))):
                    take.append(i)
                    out["list"].append(_signed(sum(1 << p for p in c)))
                    out["mask"].append(_signed(mask))
                    out["unit"].append(x.tobytes())
            picked = batch.select(["rep", "copies", "grp"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, *(pa.array(out[n], t) for n, t in (
                ("list", pa.int64()), ("mask", pa.int64()), ("unit", pa.binary())))], names=["rep", "copies", "grp", "list", "mask", "unit"])

    lists = distinct.select("rep", "copies", group.alias("grp"), "vector").mapInArrow(
        index, "rep long, copies long, grp long, list long, mask long, unit binary")
    lists = staged(lists)
    sizes = lists.groupBy("grp", "list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK)
    mine = F.pmod(F.xxhash64("rep", "mask"), chunks)
    cut = lists.join(sizes, ["grp", "list"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    units = cut.select("grp", "list", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "copies", "mask", "unit")
    order = ["grp", "list", "i", "j"]

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table[c].to_numpy() for c in order])
            if len(held) == 1 or (keys[:, 0] != keys[:, -1]).any():
                heads = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
                if len(heads):
                    yield from _compared(table.slice(0, heads[-1]), np.concatenate([[0], heads]))
                    held = table.slice(heads[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from _compared(table, np.array([0, len(table)]))

    def _compared(table: pa.Table, heads: np.ndarray):
        ids, copies, masks, mine, i, j, lists_ = (table[c].to_numpy() for c in ("rep", "copies", "mask", "mine", "i", "j", "list"))
        data = table["unit"].combine_chunks()
        found = []
        for a, b in zip(heads[:-1], heads[1:]):
            if b - a > 1:
                vectors = np.frombuffer(b"".join(data.slice(a, b - a).to_pylist()), dtype=np.float64).reshape(b - a, -1)
                left = None if i[a] == j[a] else mine[a:b]
                found.append(_links(ids[a:b], copies[a:b], masks[a:b].view(np.uint64), vectors, left, lists_[a:b].view(np.uint64)[0], shared, threshold))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["rep", "links", "root"])

    links = staged(units.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "rep long, links long, root long"))
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (
        distinct.select("k1", "k2", "rep", "copies").join(totals, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root"), F.lit(True).alias("fine"))
    )
    joined = marked.select("id", "k1", "k2", "fine").join(classes, ["k1", "k2", "fine"], "left")
    component = F.coalesce("root", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits
