"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ludograph.session import shared_folder, ship, staged

__all__ = ["Recent", "among", "dealt", "spare", "exclusive_sums", "fold", "give_back", "groups", "local_roots", "new_folder", "open_file", "prepare", "read_table", "slices", "staged", "without_collection"]

SLICE_BYTES = 2 << 20
TASK_BYTES = 32 << 20
TABLE_BITS, KEY_BITS, MARKS = 1 << 26, 16, 3  # of a table of marks: bits at most, bits for a key at least, marks of a key
_C = ctypes.CDLL(None)


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, and keep Arrow batches of long texts small."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column) -> Column:
    """True for the rows held out of training: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def open_file(path: str, mode: str = "r"):
    """A file of the shared folder, by any scheme Arrow knows: random access for reading, or a stream to write."""
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_file(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def spare(name: str, *taken: str) -> str:
    """``name``, with marks behind it until no column has it; Spark compares names without case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def dealt(rows: DataFrame, size: Column, *keys: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Deal short rows that each stand for ``size`` bytes of a file to tasks by those bytes: adaptive execution, which
    would merge them by their own few bytes, leaves a given number of partitions as it is."""
    total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(count, max(2 * cores, -(-int(total) // task_bytes)))), *keys)


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is in ``keys``, and all others, where ``keys`` are few among the rows and the rows are wide: the
    semi join and the anti join, but only rows that a table of marks cannot rule out are shuffled. The marks are hashed bits
    of the keys, some 0.5 % of other keys fit them by chance, and the join decides. The table is broadcast; it has at most
    ``TABLE_BITS`` bits, so beyond some 4 million keys more rows fit, and are shuffled. ``keys`` are read twice."""
    bits = min(TABLE_BITS, 1 << max(10, (KEY_BITS * keys.count() - 1).bit_length()))

    h = F.xxhash64(*(F.col(c).cast(keys.schema[c].dataType) for c in on))
    low, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    bit = keys.select(F.explode(F.array(*((low + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(MARKS)))).alias("bit"))
    words = bit.groupBy(F.expr("cast(bit div 32 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("word")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words["at"].to_numpy()] = words["word"].to_numpy().astype(np.uint32)
    shared = prepare(rows.sparkSession).sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def fits(hashes: pd.Series) -> pd.Series:
        x = hashes.to_numpy().view(np.uint64)
        low, step, out = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1), np.ones(len(x), bool)
        for i in range(MARKS):
            bit = low + step * np.uint64(i) & np.uint64(bits - 1)
            out &= (shared.value[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return pd.Series(out)

    own = [f"`{c}`" for c in rows.columns]
    some, others = rows.where(fits(h)), rows.where(~fits(h))
    return some.join(keys, on, "left_semi").select(own), others.union(some.join(keys, on, "left_anti").select(own))


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what they keep adds up over a job's stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


@contextmanager
def without_collection():
    """No search for cycles meanwhile: what is remembered in large tables holds none, and looking through it takes long."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = SLICE_BYTES):
    """Arrow batches cut into short ones of at most ``rows`` rows and (but for single rows) ``size`` bytes, so that
    Python objects of few rows live at a time."""
    for batch in batches:
        waiting = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part
    give_back()


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]):
    """Tables of the rows with equal integer keys, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        heads = np.flatnonzero((np.diff(values, axis=1) != 0).any(axis=0)) + 1
        if last is not None and (last != values[:, 0]).any():
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *heads.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = values[:, -1]
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def local_roots(ids: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a symmetric link matrix that have links, and the least id each reaches."""
    root = ids.copy()
    linked = np.flatnonzero(link.any(axis=1))
    inner = link[np.ix_(linked, linked)]
    while len(linked):
        new = np.minimum(root[linked], np.where(inner, root[linked][None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root[linked]).all():
            break
        root[linked] = new
    return linked, root[linked]


def exclusive_sums(df: DataFrame, order: list[str], value: str, out: str, block: Column) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows, by ``order``. ``block`` must rise with the order; it cuts
    the rows into pieces that are summed apart, so one task sees one piece, and one row per piece at the end."""
    cut = df.withColumn("_block", block)
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = cut.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        cut.withColumn("_inner", F.coalesce(inner, F.lit(0)))
        .join(totals, "_block")
        .withColumn(out, (F.col("_before") + F.col("_inner")).cast("long"))
        .drop("_block", "_inner", "_before")
    )


class Recent:
    """Values of keys, worked out once while they stay in use. Two generations of at most ``limit`` entries (or bytes,
    where ``weigh`` gives those of a key and its value) bound the memory; only speed depends on what is forgotten."""

    def __init__(self, make: Callable[[list], Iterable], limit: int, weigh: Callable | None = None):
        self.make, self.limit, self.weigh, self.young, self.old = make, limit, weigh, {}, {}
        self.held = 0

    def _weight(self, entries: dict) -> int:
        return sum(map(self.weigh, entries, entries.values())) if self.weigh else len(entries)

    def table(self, keys: set) -> dict:
        """A dictionary that holds every one of the keys."""
        missing = keys.difference(self.young)
        if missing:
            found = {k: self.old[k] for k in missing if k in self.old}
            new = list(missing.difference(found))
            found.update(zip(new, self.make(new), strict=True))
            more = self._weight(found)
            if self.held + more > self.limit:
                self.old, before = self.young, self.young
                self.young = {k: before[k] for k in keys if k in before}
                self.held = self._weight(self.young)
            self.young.update(found)
            self.held += more
        return self.young

    def lookup(self, lists: list[list]) -> Callable:
        """A function that gives the value of every key of the lists. Most keys are held, so only others are collected."""
        held, new = self.young, set()
        for keys in lists:
            new.update(filterfalse(held.__contains__, keys))
        if self.table(new) is not held:  # a generation ended, and keys that were held may be in the older one
            self.table(set().union(*lists))
        return self.young.__getitem__
