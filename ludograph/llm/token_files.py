"""Token ids of documents in binary files, with Elias-Fano coded document boundaries.

A file holds the ids of many documents one after another (16 or 32 bits each, little-endian), then two Elias-Fano
sequences: the ends of the documents within the file, and the document ids. A footer names the sizes. Boundaries
take a few bits a document; no table of 64-bit offsets is written or built by readers.

Files follow the ascending document id (ties: by hash of the text; null ids first). Tasks write under names
of their own and report them; only the names of finished tasks get into the returned manifest, so a lost or
repeated task leaves at most an unused file. Files are cut at ``max_ids`` ids.

A null text is an empty document and has only the end id. An empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import Recent, dealt, exclusive_sums, new_folder, open_file, prepare, slices, staged, without_collection
from ludograph.llm.elias_fano import EliasFano

MAGIC = b"EFTOKEN1"
MAX_IDS = 1 << 26
CACHED = 450_000
_FOOT = struct.Struct("<QQQBQQ8s")  # documents, null ids, ids, bytes an id, bytes of ends, bytes of document ids
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"

_encoders: dict[bytes, TextEncoder] = {}


def _drops_blanks(shape: dict) -> bool:
    """Whether a tokenizer composes and lowers letters and cuts texts into letters, digits and other signs, without the
    white space between them, and nothing else. Of such a one pieces between blanks can be encoded apart."""
    steps = (shape.get("normalizer") or {}).get("normalizers") or []
    first = ((shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("content") == " "
        and steps[1].get("pattern") == {"Regex": r"\s+"} and first.get("type") == "Split" and first.get("invert") is True
        and first.get("behavior") == "Removed" and first.get("pattern") == {"Regex": words}
    )


class TextEncoder:
    """A tokenizer of the ``tokenizers`` library. Of one that drops white space each distinct piece between blanks is
    encoded once, and a letter run with ASCII marks behind it is cut there, since it never joins the two; texts go whole
    through any other."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.proven = _drops_blanks(json.loads(model))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.shape = regex.compile(r"(\p{L}+)([!-&(-/:-@\[-`{-~]*)")
        self.words = Recent(self._encode_words, CACHED)
        self.pieces = Recent(self._encode_pieces, CACHED)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            line = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            owner = np.array(line.word_ids, dtype=np.int64)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(heads) == len(part) and all(map(str.isalpha, part)):
                raw, size = self._bytes(line.ids), self.kind.itemsize
                ends = [*(heads[1:] * size).tolist(), len(raw)]
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:
                out += self._each(part)
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        plain, rest = [p for p in pieces if p.isalpha()], [p for p in pieces if not p.isalpha()]
        fit = {p: m for p in rest if "<|" not in p and (m := self.shape.fullmatch(p))}
        known = self.words.table({*plain, *(m[1] for m in fit.values()), *(m[2] for m in fit.values() if m[2])})
        out = {p: known[m[1]] + (known[m[2]] if m[2] else b"") for p, m in fit.items()}
        whole = [p for p in rest if p not in fit]
        out.update(zip(whole, self._each(whole)))
        return [known[p] if p not in out else out[p] for p in pieces]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.proven:
            return self._each([t or "" for t in texts])
        parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
        known = self.pieces.lookup(parts)
        return [b"".join(map(known, p)) for p in parts]


def encoder(model: str) -> TextEncoder:
    """The encoder of this worker process for a tokenizer's JSON text; one is held at a time."""
    key = hashlib.sha256(model.encode()).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(model)
    return _encoders[key]


class _File:
    def __init__(self, folder: str, part: int, seq: int, kind: np.dtype):
        self.path = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
        self.part, self.seq, self.kind = part, seq, kind
        self.out = open_file(self.path, "w")
        self.counts: list[int] = []
        self.keys: list[int] = []
        self.nulls = self.n_ids = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.counts.append(len(ids) // self.kind.itemsize)
        self.n_ids += self.counts[-1]
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> tuple:
        ends = EliasFano.of(np.cumsum(np.array(self.counts, dtype=np.int64))).dumps()
        keys = EliasFano.of(np.array(self.keys, dtype=np.int64)).dumps()
        foot = _FOOT.pack(len(self.counts), self.nulls, self.n_ids, self.kind.itemsize, len(ends), len(keys), MAGIC)
        self.out.write(ends + keys + foot)
        self.out.close()
        return self.part, self.seq, self.path, len(self.counts), self.n_ids


class TokenFile:
    """Random access to one file: only the footer, the boundaries and the wanted ids are read."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        foot = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        self.n_docs, self.nulls, self.n_ids, self.width, ends, keys, magic = foot
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        tail = self.file.read_at(ends + keys, size - _FOOT.size - ends - keys)
        self.ends, self.keys = EliasFano.loads(tail[:ends]), EliasFano.loads(tail[ends:])

    def bounds(self, start: int, stop: int) -> np.ndarray:
        """Offsets of documents start..stop-1, and the end of the last."""
        before = self.ends.select(start - 1) if start else np.zeros(1, np.int64)
        return np.concatenate([before, self.ends.select(start, stop)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width, start * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, i + 1)
        return self.ids(int(a), int(b))


def write_token_files(df: DataFrame, model: str, end_id: int, key: str = "doc_id", text: str = "text",
                      folder: str | None = None, max_ids: int = MAX_IDS) -> DataFrame:
    """Encode, append ``end_id`` to each document and write. Returns the manifest: the files in order, with the
    number of ids ``before`` each. ``model`` is the tokenizer's JSON text; it is broadcast (a few MB)."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    folder = folder or new_folder(spark, "token-files")

    def write(batches):
        with without_collection():
            yield from written(batches)

    def written(batches):
        tool, part, file, seq = encoder(shared.value), TaskContext.get().partitionId(), None, 0
        end = np.array([end_id], dtype=tool.kind).tobytes()
        done = []
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, tool.encode(batch.column(1).to_pylist())):
                if file and file.n_ids + len(ids) > max_ids:
                    done.append(file.close())
                    file, seq = None, seq + 1
                file = file or _File(folder, part, seq, tool.kind)
                file.add(k, ids + end)
        if file:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (
                pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "seq", "path", "n_docs", "n_ids"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = ["key", "tie"]
    sorted_rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = staged(sorted_rows.select("key", "text").mapInArrow(write, MANIFEST))
    return exclusive_sums(manifest, ["part", "seq"], "n_ids", "before", F.floor(F.col("part") / 256))


def read_token_files(manifest: DataFrame, ids: bool = True, window: int = 1 << 22) -> DataFrame:
    """One row a document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as unsigned 32-bit little-endian numbers) and, if wanted, ``ids``. At most about
    ``window`` ids (or one document's) are in memory. Files are read in parts of about four windows, by many tasks."""
    prepare(manifest.sparkSession)

    def read(batches):
        for batch in batches:
            for path, before, part, size in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(path)
                step = max(1, min(2000, window * file.n_docs // max(file.n_ids, 1)))
                stop = min(part + size, file.n_docs)
                for a in range(part, stop, step):
                    b = min(a + step, stop)
                    ends = file.bounds(a, b)
                    keys = [None] * max(0, min(file.nulls, b) - a)
                    keys += file.keys.select(max(a, file.nulls) - file.nulls, b - file.nulls).tolist()
                    crcs, lists = [], []
                    flat, bounds = file.ids(int(ends[0]), int(ends[-1])), (ends - ends[0]).tolist()
                    for s, e in zip(bounds[:-1], bounds[1:]):
                        one = flat[s:e]
                        crcs.append(zlib.crc32(one.astype("<u4").tobytes()))
                        if ids:
                            lists.append(one.astype(np.int32))
                    columns = [pa.array(keys, pa.int64()), pa.array(before + ends[:-1]), pa.array(np.diff(ends)),
                               pa.array(crcs, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.array(lists, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_docs") * (4 * window) / F.greatest("n_ids", F.lit(1))))
    files = manifest.where("n_docs > 0").select("path", "before", "n_docs", "n_ids", size.alias("size"))
    parts = files.withColumn("part", F.explode(F.expr("sequence(0L, n_docs - 1, size)")))
    ids_of = F.least("size", F.col("n_docs") - F.col("part")) * F.col("n_ids") / F.col("n_docs")
    return dealt(parts, ids_of * 4, "path", "part").select("path", "before", "part", "size").mapInArrow(read, schema)
