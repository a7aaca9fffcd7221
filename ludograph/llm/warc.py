"""WARC archives of pages: writing with revisit records, and reading that proves where records begin.

Reading cuts every file into blocks. A task looks for the magic of a record header in its block, and emits the
offset of each candidate with the offset of its successor, which the header's length gives. Inside a block the chains are
followed at once, so each candidate leads to the first offset beyond the block. Pointer jumping over the few
offsets where a chain enters a block then keeps those that the file's start reaches; it takes about
log2(blocks a file) rounds. A magic inside a payload is reached by no chain and is never read as a record.
A chain that breaks (a file cut short) ends there: the whole records before the break are returned. In files that
``write_warc`` lists as whole a break is an error. Headers may be of any length: HEADER is only what is read at first.

Files are written uncompressed. Tasks write under names of their own; only those of finished tasks are in the
manifest. A null payload is an empty one. Of equal payloads of at least ``min_bytes`` the smallest id is a response (rows
that repeat it too; rows without an id, if none has one) and the others revisit it. An empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.llm.common import dealt, new_folder, open_file, prepare, slices, staged

BLOCK = 8 << 20
MAX_FILE = 1 << 30
HEADER = 1 << 16
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d{1,18})\r\n", re.I)
_ID = "urn:page:"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit of the record of page ``first``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{_ID}{first}>")]
    body = http + (payload if first is None else b"")
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class Window:
    """The bytes of a file from ``start`` to ``end``, and beyond as far as a header or record needs. Headers are asked for
    in ascending order; the next blank line and length are kept, so that each byte is searched once."""

    def __init__(self, path: str, start: int, end: int, size: int):
        self.file, self.start, self.size = open_file(path), start, size
        self.data = self.file.read_at(min(end + HEADER, size) - start, start)
        self.blank, self.length = -1, None

    def read_to(self, n: int) -> bool:
        """Read on until ``n`` bytes are held. False if the file ends before."""
        if n > len(self.data):
            n_more = min(max(n, len(self.data) * 5 // 4), self.size - self.start) - len(self.data)
            self.data += self.file.read_at(n_more, self.start + len(self.data))
        return len(self.data) >= n

    def header_at(self, at: int) -> tuple[int, int] | None:
        """Where the content starts and the next record begins, if a header stands here."""
        if not _MAGIC.match(self.data, at):
            return None
        if self.blank < at:
            self.blank = self._blank_from(at)
            self.length = _LENGTH.search(self.data, at, self.blank + 2)
        elif self.length and self.length.start() < at:
            self.length = _LENGTH.search(self.data, at, self.blank + 2)
        end = self.blank + 4
        return (end, end + int(self.length[1]) + 4) if self.length and end <= len(self.data) else None

    def _blank_from(self, at: int) -> int:
        """The next blank line; the file's end, if there is none."""
        step = HEADER
        while (found := self.data.find(b"\r\n\r\n", at)) < 0:
            held = len(self.data)
            if not self.read_to(held + step) and len(self.data) == held:
                return self.size
            at, step = max(at, held - 3), 2 * step
        return found


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
               folder: str | None = None, max_file: int = MAX_FILE) -> DataFrame:
    """Write one record a row. Returns the manifest: ``path`` and ``size`` of each file, and ``whole`` = true."""
    spark = prepare(pages.sparkSession)
    folder = folder or new_folder(spark, "warc")

    def write(batches):
        path, out, size = None, None, 0
        for batch in slices(batches):
            for page_id, link, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                record = make_record(page_id, link, (html or "").encode(), first)
                if out and size + len(record) > max_file:
                    out.close()
                    yield _row(path, size)
                    out, size = None, 0
                if not out:
                    path = f"{folder}/{uuid.uuid4().hex}.warc"
                    out = open_file(path, "w")
                out.write(record)
                size += len(record)
        if out:
            out.close()
            yield _row(path, size)

    def _row(path: str, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [path], "size": [size], "whole": [True]})

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= min_bytes
    hashed = rows.withColumn("sha", F.when(large, F.sha1("html")))
    firsts = (
        rows.where(large).groupBy(F.sha1("html").alias("sha"))
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    )
    # Written first, so that its size is known: while it is small, pages are marked where they are read.
    marked = hashed.join(staged(firsts), "sha", "left")
    revisit = F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    return staged(marked.select("key", "url", "html", revisit.alias("first")).mapInArrow(write, "path string, size long, whole boolean"))


def manifest_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The manifest of files made elsewhere. They may be cut short."""
    return spark.createDataFrame([(p, open_file(p).size()) for p in paths], "path string, size long")


def candidates(manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every place that looks like a record: path, size, offset, the offset ``next`` of its successor, and ``leaves``:
    the first offset beyond the block that its chain leads to (null if the chain breaks in the block)."""

    def scan(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                end = min(start + block, size)
                window = Window(path, start, end, size)
                found = {}
                for m in _MAGIC.finditer(window.data, 0, min(end - start + 16, len(window.data))):
                    head = window.header_at(m.start()) if m.start() < end - start else None
                    if head and start + head[1] <= size:
                        found[start + m.start()] = start + head[1]
                leaves: dict[int, int | None] = {}
                for at in sorted(found, reverse=True):
                    leaves[at] = found[at] if found[at] >= end else leaves.get(found[at])
                offsets = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(offsets), pa.string()), pa.array([size] * len(offsets), pa.int64()),
                     pa.array(offsets, pa.int64()), pa.array([found[o] for o in offsets], pa.int64()),
                     pa.array([leaves[o] for o in offsets], pa.int64())],
                    names=["path", "size", "offset", "next", "leaves"])

    prepare(manifest.sparkSession)
    starts = F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {block}L)"))
    blocks = manifest.where("size > 0").select("path", "size", starts.alias("start"))
    blocks = dealt(blocks, F.least(F.lit(block), F.col("size") - F.col("start")), "path", "start")
    return blocks.mapInArrow(scan, "path string, size long, offset long, next long, leaves long")


def entries(found: DataFrame, whole: DataFrame) -> DataFrame:
    """The first record of each block, by pointer jumping from the files' starts: path, size, offset, and whether the file
    must be whole. In those of ``whole`` (path, size), places where a chain meets no record are kept, for the reader to
    report."""
    chained = found.where("leaves is not null or offset = 0")
    heads = chained.select("path", F.col("leaves").alias("offset")).where("offset is not null").distinct()
    nodes = found.select("path", "size", "offset", "leaves")
    inner = nodes.where("offset > 0").join(heads, ["path", "offset"])
    nodes = nodes.where("offset = 0").unionByName(inner)
    pointers = staged(nodes.select("path", "size", "offset", F.col("leaves").alias("to")))
    reached = pointers.where("offset = 0").select("path", "offset")
    while not pointers.where("to < size").isEmpty():
        ahead = pointers.where("to < size").select("path", "offset", "to")
        steps = reached.join(ahead, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        reached = staged(reached.unionByName(steps).distinct())
        onward = pointers.select("path", F.col("offset").alias("to"), F.col("to").alias("then"))
        pointers = staged(
            pointers.join(onward, ["path", "to"], "left")
            .select("path", "size", "offset", F.when(F.col("to") < F.col("size"), F.col("then")).alias("to"))
        )
    sizes = found.where("offset = 0").select("path", "size")
    known = found.select("path", "offset")  # the last offset of a chain may hold no record
    good = reached.join(known, ["path", "offset"], "left_semi").join(sizes, "path")
    firsts = whole.select("path", F.lit(0).cast("long").alias("offset"))
    met = reached.unionByName(firsts).distinct().join(whole, "path").where("offset < size")
    return (
        good.join(whole.select("path"), "path", "left_anti").withColumn("whole", F.lit(False))
        .unionByName(met.withColumn("whole", F.lit(True)))
    )


def read_warc(manifest: DataFrame, block: int = BLOCK, payloads: bool = True) -> DataFrame:
    """One row a record: ``path``, ``offset``, ``record_type``, ``record_id``, ``refers_to``, ``url``,
    ``payload_bytes`` and ``payload_digest`` (of the full payload; for a revisit as its header tells) and, if wanted,
    ``payload``. Raises if a payload does not match its digest, or if the records of a file listed as ``whole`` end before
    the file does."""

    def read(batches):
        for batch in batches:
            for path, size, start, must in zip(*(c.to_pylist() for c in batch.columns)):
                end = min((start // block + 1) * block, size)
                window = Window(path, start, end, size)
                rows, at, held = [], 0, 0
                while start + at < end:
                    head = window.header_at(at)
                    if not head or not window.read_to(head[1]):
                        if must:
                            raise ValueError(f"no whole record at {start + at} of {path}, which should have {size} bytes")
                        break
                    data = window.data
                    rows.append((path, start + at, *_parse(data[at : head[0]], data[head[0] : head[1] - 4])))
                    held += head[1] - at
                    at = head[1]
                    if held > 1 << 22:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    fields = [("path", "string"), ("offset", "long"), ("record_type", "string"), ("record_id", "string"),
              ("refers_to", "string"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string")]
    fields += [("payload", "binary")] if payloads else []
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in range(len(fields) + (not payloads))]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)],
                                          names=[n for n, _ in fields])

    found = staged(candidates(manifest, block))
    own = F.col("whole") if "whole" in manifest.columns else F.lit(False)
    whole = manifest.where(own & (F.col("size") > 0)).select("path", "size")
    begin = staged(entries(found, whole).select("path", "size", "offset", "whole"))
    ends = F.least((F.floor(F.col("offset") / block) + 1) * block, F.col("size"))
    begin = dealt(begin, ends - F.col("offset"), "path", "offset")
    return begin.mapInArrow(read, ", ".join(f"{n} {k}" for n, k in fields))


def _parse(head: bytes, content: bytes) -> tuple:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, _, payload = content.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = _LENGTH.search(b"\r\n" + http + b"\r\n")
        n, digest, payload = int(length[1]) if length else None, told, None
    else:
        n, digest = len(payload), _digest(payload)
        if told and told != digest:
            raise ValueError(f"payload digest {digest}, but the header has {told}")
    return (kind, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-refers-to", "").strip("<>") or None,
            fields.get("warc-target-uri"), n, digest, payload)


def page_of(record: str) -> Column:
    """The page id that ``make_record`` put into a record id; null if it had none."""
    return F.expr(f"try_cast(substring({record}, {len(_ID) + 1}) as long)")
