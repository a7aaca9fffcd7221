"""Token counts from flat token files without an index: a vectorised search for the end-of-document id.

Files hold 16 or 32 bit ids one after another, each document closed by the separator; nothing tells where documents
begin. Every file is cut into blocks. A task searches its block in numpy and emits the places of the separators, and one
summary row: how many there are and where the last one is. A prefix scan over the summaries (exclusive sum and
exclusive maximum, in two levels, so no task sees all blocks of a huge file) tells each block the number of its first
document and where it began, which stitches documents that cross blocks.

What follows the last separator of a file is a document that is not ``closed``. Empty files have no documents. A file whose
size is no multiple of the width of an id is an error.
"""

from __future__ import annotations

import base64
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludograph.llm.common import dealt, new_folder, open_file, prepare, slices, staged

BLOCK = 1 << 22
SUPER = 1024
MAX_FILE = 1 << 26


def write_flat_tokens(docs: DataFrame, ranks: bytes, pattern: str, separator: int, key: str = "doc_id", text: str = "text",
                      folder: str | None = None, max_file: int = MAX_FILE) -> DataFrame:
    """Encode with a rank file (by the tiktoken library) and write flat 16-bit files. Returns a row a document: ``path``,
    ``bytes`` of the file, ``ordinal`` of the document in it, and its ``key``. Null texts are empty documents."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ranks)
    folder = folder or new_folder(spark, "flat-tokens")

    def write(batches):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        if max(separator, *table.values()) >= 1 << 16 or separator in table.values():
            raise ValueError("the separator and all ids must be different and fit 16 bits")
        tool = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        out, keys, nulls = None, array("q"), set()
        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out and out.tell() >= max_file:
                    out.close()
                    yield from _listed(path, out_bytes, keys, nulls)
                    out = None
                if not out:
                    path, keys, nulls = f"{folder}/{uuid.uuid4().hex}.tok", array("q"), set()
                    out = open_file(path, "w")
                out.write(np.array([*tool.encode_ordinary(t or ""), separator], dtype="<u2").tobytes())
                out_bytes = out.tell()
                if k is None:
                    nulls.add(len(keys))
                keys.append(k or 0)
        if out:
            out.close()
            yield from _listed(path, out_bytes, keys, nulls)

    def _listed(path: str, size: int, keys: array, nulls: set):
        for a in range(0, len(keys), 10_000):
            some = [None if i in nulls else k for i, k in enumerate(keys[a : a + 10_000], a)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([size] * len(some), pa.int64()),
                                              pa.array(range(a, a + len(some)), pa.int64()), pa.array(some, pa.int64())], names=["path", "bytes", "ordinal", key])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return staged(rows.mapInArrow(write, f"path string, bytes long, ordinal long, `{key}` long"))


def count_tokens(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """One row a document of the files (``path``, ``bytes``): ``path``, ``ordinal`` in the file, ``n_tokens`` without the
    separator, ``closed``. ``block`` is in ids."""

    def search(batches):
        for batch in batches:
            for path, size, b in zip(*(c.to_pylist() for c in batch.columns)):
                if size % width:
                    raise ValueError(f"{path} has {size} bytes, which is not a whole number of ids of {width} bytes")
                start = b * block
                stop = min(start + block, size // width)
                ids = np.frombuffer(open_file(path).read_at((stop - start) * width, start * width), dtype=f"<u{width}")
                at = np.flatnonzero(ids == separator) + start
                closed = np.ones(len(at), bool)
                if stop == size // width and (not len(at) or at[-1] != stop - 1):
                    at, closed = np.append(at, stop), np.append(closed, False)
                inner = np.concatenate([[-1], at[:-1]]) if len(at) else at
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(at), pa.string()), pa.array(np.full(len(at), b)), pa.array(np.arange(len(at))), pa.array(at, pa.int64()),
                    pa.array(inner, pa.int64(), mask=np.arange(len(at)) == 0), pa.array(closed)], names=["path", "b", "k", "at", "before", "closed"])

    prepare(files.sparkSession)
    wanted = files.where("bytes > 0").select("path", "bytes").distinct()
    last = F.floor((F.ceil(F.col("bytes") / width) - 1) / block)
    blocks = wanted.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = dealt(blocks, F.least(F.lit(block * width), F.col("bytes") - F.col("b") * block * width), "path", "b")
    found = staged(blocks.mapInArrow(search, "path string, b long, k long, at long, before long, closed boolean"))

    summary = found.groupBy("path", "b").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).withColumn("s", F.floor(F.col("b") / SUPER))
    earlier = Window.partitionBy("path", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy("path").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    totals = summary.groupBy("path", "s").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    totals = totals.select("path", "s", F.sum("n").over(upper).alias("super_n"), F.max("last").over(upper).alias("super_last"))
    stitched = summary.withColumns({"own_n": F.sum("n").over(earlier), "own_last": F.max("last").over(earlier)}).join(totals, ["path", "s"]).select(
        "path", "b", (F.coalesce("own_n", F.lit(0)) + F.coalesce("super_n", F.lit(0))).alias("base"), F.coalesce("own_last", "super_last", F.lit(-1)).alias("carried"))
    return found.join(stitched, ["path", "b"]).select(
        "path", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("at") - F.coalesce("before", "carried") - 1).alias("n_tokens"), "closed")
