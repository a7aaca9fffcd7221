"""Alignment of the tokens of two tokenizers over the same bytes.

Method: divide and conquer at shared cuts. Byte offsets where tokens of both sides end are cuts. Within an interval that
begins and ends at cuts, the ends near the middle of one side are looked up in the other side's by bisection; the first
that both have splits the interval and both halves are worked on alike. An interval without one is a leaf: a group of
tokens that cannot be split. Within a group, tokens are linked where their byte ranges overlap.

Texts are first cut at blanks between visible characters, as far as both vocabularies prove that no token reaches over
such a place; each distinct piece is encoded and aligned once while it stays in a worker's bounded memory. The links of a
text are kept as distinct pairs with their numbers, so the corpus counts are a grouped sum and meet the texts in one
join, broadcast up to a checked number of pairs and salted beyond it. No text is shuffled.

Side A is a byte-level BPE of the ``tokenizers`` library over blank + text, side B a ``sentencepiece`` model, which adds
the blank itself; special tokens' strings are plain text for both. A text that is null or empty, or whose tokens' joined
bytes differ from blank + text on either side, has no tokens. There is one result row per row, repeated ids included; an
empty table gives no rows. Only key and text are read, so further columns and their names do not matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import Recent, prepare, slices, staged, without_collection

CACHED_BYTES = 128 << 20  # of each of two generations, in a worker
MAX_MODEL = 64 << 20
MAX_PAIRS = 4_000_000  # pairs of ids that are broadcast, some 100 MB; a vocabulary's usual pairs are far fewer
SALTS = 32
PROBES = 64
ALIGNED = ("row long, key long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "links array<struct<a:int,b:int,n:int>>")

_aligners: dict[bytes, Aligner] = {}


def shared_cuts(a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For two rising arrays of ends with the same last one: how many of each lie up to each shared end, in order.
    ``known`` are shared ends to begin with. All open intervals take a step at a time; one that shows no shared end in
    ``PROBES`` steps is looked through in one."""
    limits = a[-1:] if known is None else known
    a1, b1 = np.searchsorted(a, limits) + 1, np.searchsorted(b, limits) + 1
    a0, b0 = np.append(0, a1[:-1]), np.append(0, b1[:-1])
    step = np.zeros(len(a0), dtype=np.int64)
    cuts = [a[a1 - 1]]
    while len(a0):
        at = (a0 + a1 - 1) // 2 + (step + 1) // 2 * np.where(step % 2, 1, -1)
        inside = (at >= a0) & (at < a1 - 1)
        ends = a[np.where(inside, at, a0)]
        place = np.searchsorted(b, ends)
        hit = inside & (b[np.minimum(place, len(b) - 1)] == ends)
        cuts.append(ends[hit])
        step += 1
        late = ~hit & (step >= PROBES) & (step < a1 - a0)
        for i in np.flatnonzero(late):
            cuts.append(np.intersect1d(a[a0[i] : a1[i] - 1], b[b0[i] : b1[i] - 1], assume_unique=True))
        more = ~hit & ~late & (step < a1 - a0)
        h, p = at[hit] + 1, place[hit] + 1
        zero = np.zeros(2 * len(h), dtype=np.int64)
        a0, a1, b0, b1, step = (np.concatenate(x) for x in (
            (a0[more], a0[hit], h), (a1[more], h, a1[hit]), (b0[more], b0[hit], p), (b1[more], p, b1[hit]), (step[more], zero)))
        wide = a1 - a0 > 1
        a0, a1, b0, b1, step = a0[wide], a1[wide], b0[wide], b1[wide], step[wide]
    shared = np.sort(np.concatenate(cuts))
    return np.searchsorted(a, shared) + 1, np.searchsorted(b, shared) + 1


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs whose ranges overlap, and the end of what they share, for two rising arrays of ends with the
    same last one: every stretch between two ends next to each other belongs to one pair of its own."""
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends), ends


def _bytes_of(piece: str, found: tuple | None) -> int:
    return 400 + len(piece) + (len(found[3]) + len(found[4]) if found else 0)


class Aligner:
    """Both tokenizers in a worker process."""

    def __init__(self, model_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(model_a), SentencePieceProcessor(model_proto=model_b)
        self.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # as byte-level vocabularies write bytes
        hidden = [x for x in range(256) if x not in visible]
        byte_of = {**{chr(x): x for x in visible}, **{chr(256 + i): x for i, x in enumerate(hidden)}}
        self.bytes_a = {i: bytes(map(byte_of.get, t)) if set(t) <= byte_of.keys() else t.encode()
                        for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.zeros(max(self.bytes_a) + 1, dtype=np.int64), np.array(list(map(len, self.bytes_b)))
        for i, t in self.bytes_a.items():
            self.size_a[i] = len(t)
        self.most = max(len(self.size_a), len(self.size_b))
        self.written = np.array([f"{i}{sign}" for sign in ",|;" for i in range(self.most)], dtype=object)
        shape = json.loads(model_a)
        before = shape.get("pre_tokenizer") or {}
        # The byte-level pattern never joins a visible character and a blank behind it; neither does a piece.
        self.cuts = (shape.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                     and not before.get("add_prefix_space") and not any("▁" in p.lstrip("▁") for p in pieces))
        self.odd = re.compile(r"\s | \s|\A | \Z")
        self.between = re.compile(r"(?<=\S) (?=\S)")
        self.pieces = Recent(self._align, CACHED_BYTES, _bytes_of)

    def cut(self, text: str) -> list[str]:
        """Pieces that stand behind one blank each."""
        if not self.cuts:
            return [text]
        return self.between.split(text) if self.odd.search(text) else text.split(" ")

    def _encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        of_a, of_b = [], []
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            of_a += [e.ids for e in self.a.encode_batch_fast([" " + p for p in part], add_special_tokens=False)]
            of_b += self.b.encode(part, num_threads=1)
        return of_a, of_b

    def _joined(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.bytes_a.__getitem__, a)), b"".join(map(self.bytes_b.__getitem__, b))

    def _align(self, pieces: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, links, groups as text) of each piece; None where the bytes differ."""
        of_a, of_b = self._encode(pieces)
        fit = [i for i, p in enumerate(pieces) if self._joined(of_a[i], of_b[i]) == ((" " + p).encode(),) * 2]
        out: list[tuple | None] = [None] * len(pieces)
        if not fit:
            return out
        n_a, n_b = (np.array([len(side[i]) for i in fit]) for side in (of_a, of_b))
        ids_a, ids_b = (np.array([t for i in fit for t in side[i]], dtype=np.int64) for side in (of_a, of_b))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])  # the pieces one after another
        limits = ends_a[np.cumsum(n_a) - 1]
        cut_a, cut_b = shared_cuts(ends_a, ends_b, limits)
        last = np.searchsorted(ends_a[cut_a - 1], limits) + 1
        i, j, ends = overlaps(ends_a, ends_b)
        links, until = ids_a[i] << 32 | ids_b[j], np.searchsorted(ends, limits) + 1
        # The ids of a group's A tokens, then of its B tokens, each with the sign behind it.
        signs_a, signs_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        signs_a[cut_a - 1], signs_b[cut_b - 1] = 1, 2
        group = np.concatenate([np.searchsorted(cut_a, np.arange(len(ids_a)), "right"),
                                np.searchsorted(cut_b, np.arange(len(ids_b)), "right")])
        order = np.argsort(group, kind="stable")
        words = self.written[np.concatenate([signs_a * self.most + ids_a, signs_b * self.most + ids_b])[order]].tolist()
        raw, w = links.tobytes(), 0
        for k, a, b, g, g0, s, s0 in zip(fit, n_a.tolist(), n_b.tolist(), last.tolist(), [0, *last[:-1].tolist()],
                                         until.tolist(), [0, *until[:-1].tolist()]):
            out[k] = a, b, g - g0, raw[8 * s0 : 8 * s], "".join(words[w : w + a + b])[:-1]
            w += a + b
        return out

    def align(self, texts: list[str | None]):
        """(tokens of A, of B, groups, groups as text, linked pairs, how often each) of each text."""
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.pieces.table(set().union(*cut))
        nothing = np.zeros(0, np.int64)
        for parts in cut:
            found = list(map(known.__getitem__, parts))
            if not found or None in found:
                yield 0, 0, 0, "", nothing, nothing
                continue
            a, b, n, links, groups = zip(*found)
            pairs, times = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
            yield sum(a), sum(b), sum(n), ";".join(groups), pairs, times


def aligner(model_a: str, model_b: bytes) -> Aligner:
    """The aligner of this worker process for two models; one pair of models is held at a time."""
    key = hashlib.sha256(model_a.encode() + b"\0" + model_b).digest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(model_a, model_b)
    return _aligners[key]


def align_texts(df: DataFrame, model_a: str, model_b: bytes, key: str = "doc_id", text: str = "text",
                digest: bool = False) -> DataFrame:
    """One row a text: ``row`` (its own number), ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` like
    ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its SHA-256) and ``links``: linked pairs of ids and how often."""
    if len(model_a) + len(model_b) > MAX_MODEL:
        raise ValueError("the models are too large to broadcast")
    shared = prepare(df.sparkSession).sparkContext.broadcast((model_a, model_b))

    def work(batches):
        with without_collection():
            yield from aligned(batches)

    def aligned(batches):
        tool = aligner(*shared.value)
        for batch in slices(batches):
            rows = list(tool.align(batch.column(2).to_pylist()))
            n_a, n_b, n_groups, groups, pairs, times = map(list, zip(*rows))
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            sizes = np.array(list(map(len, pairs)))
            flat, n = np.concatenate(pairs), np.concatenate(times)
            links = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(
                [pa.array((flat >> 32).astype(np.int32)), pa.array((flat & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(n.astype(np.int32))], names=["a", "b", "n"]))
            n_links = np.array(list(map(np.sum, times)), dtype=np.int64)
            columns = [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)],
                       pa.array(groups, pa.string()), links]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` of all linked pairs of the corpus, and whether it is the highest of its ``b``."""
    counts = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("count"))
    counts = staged(counts)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return staged(counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best")))


def judge_links(aligned: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Add to each text ``n_best``, its links whose pair is the most frequent of its ``b``, and ``count_sum``, the sum of
    the pairs' counts over all links; ``links`` goes. ``aligned`` is stored, so rows keep their numbers."""
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups"]
    links = aligned.select("row", *names, F.explode_outer("links").alias("l")).select("row", *names, "l.*")
    if counts.count() <= max_pairs:
        joined = links.join(F.broadcast(counts), ["a", "b"], "left")
    else:  # frequent pairs stand in most texts, so every pair is spread over some tasks
        salted = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        links = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = links.join(salted.hint("merge"), ["a", "b", "salt"], "left")
    zero = F.lit(0).cast("long")
    return joined.groupBy("row", *names).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("n").cast("long"))), zero).alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("count")), zero).alias("count_sum"),
    )
