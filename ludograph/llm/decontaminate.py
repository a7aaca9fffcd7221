"""Benchmark decontamination: rare n-gram seeds find passages, local alignment of words scores them.

1. How many documents hold each ``GRAM``-word run of the test items is counted over the whole corpus.
2. Of every ``SPAN`` neighbouring runs of an item the rarest is a seed, so each stretch of an item has one however
   often the item was copied.
3. Every document is searched for seeds. Hits of one item on near diagonals give a passage.
4. Smith-Waterman alignment of item and passage (match 2, mismatch and gap -1) gives the score: the share of the best
   possible 2 x words. An exact copy scores 1; edited and shortened ones less.

Documents are only scanned, never shuffled. Items are broadcast in groups of at most ``ITEM_BYTES`` of text, checked
beforehand; a larger benchmark takes several scans. The driver holds counts of one group's runs.

Items without words and null or empty texts match nothing. An item shorter than a run matches only a text of just its words.
A copy so edited that none of its seeds is left is not found. Repeated items and
documents give a row for each pair. An empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import prepare, slices
from ludograph.llm.words import gram_hashes, word_hashes

GRAM = 3
SPAN = 2
ITEM_BYTES = 16 << 20
THRESHOLD = 0.5
FILTER_BITS = 20


class Items:
    """Word hashes and runs of a group of test items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words, self.first = word_hashes(pa.array(texts, pa.string()))
        self.grams, self.place = gram_hashes(self.words, self.first, GRAM, short=True)
        self.distinct = np.unique(self.grams)

    def of(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item + 1]]

    def choose_seeds(self, counts: np.ndarray) -> None:
        """``counts``: documents that hold each of ``distinct``."""
        frequency = counts[np.searchsorted(self.distinct, self.grams)]
        chosen = np.zeros(len(self.grams), bool)
        for a, b in zip(self.place[:-1], self.place[1:]):
            for s in range(a, max(b - SPAN + 1, a + (b > a))):
                chosen[s + int(frequency[s : min(s + SPAN, b)].argmin())] = True
        at = np.flatnonzero(chosen)
        at = at[np.argsort(self.grams[at], kind="stable")]
        self.seeds, self.seed_at = self.grams[at], at - self.place[:-1][np.searchsorted(self.place, at, side="right") - 1]
        self.seed_item = np.searchsorted(self.place, at, side="right") - 1
        self._lookup = None

    def lookup(self) -> Lookup:
        if self._lookup is None:
            self._lookup = Lookup(np.unique(self.seeds))
        return self._lookup


class Lookup:
    """Which of many hashes are in a sorted list: a bit table first, then a binary search of what is left."""

    def __init__(self, values: np.ndarray):
        self.values, self.shift = values, np.uint64(64 - FILTER_BITS)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(values >> self.shift).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the list."""
        maybe = np.flatnonzero(self.bits[(hashes >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), max(len(self.values) - 1, 0))
        return maybe[self.values[at] == hashes[maybe]] if len(self.values) else maybe[:0]


def align(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Best local alignment score of the item's words with each row (padded with 0) of passages."""
    rows, width = passages.shape
    last = np.zeros((rows, width + 1), np.int32)
    best = np.zeros(rows, np.int32)
    step = np.arange(width + 1, dtype=np.int32)
    for word in item:
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(last[:, :-1] + np.where(passages == word, 2, -1), last[:, 1:] - 1)
        np.maximum(now, 0, out=now)
        last = np.maximum.accumulate(now + step, axis=1) - step  # gaps along the passage
        best = np.maximum(best, last.max(axis=1))
    return best


def _item_groups(benchmark: DataFrame, key: str, text: str) -> list[DataFrame]:
    """The items in groups that are small enough to broadcast: at most ``2 * ITEM_BYTES`` of text each."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    bytes_of = F.octet_length("text").cast("long")
    size, longest = items.agg(F.coalesce(F.sum(bytes_of), F.lit(0)), F.coalesce(F.max(bytes_of), F.lit(0))).first()
    if longest > ITEM_BYTES:
        raise ValueError(f"a test item of {longest} bytes; items are broadcast, so at most {ITEM_BYTES} are taken")
    if size <= ITEM_BYTES:
        return [items]
    groups, largest = int(size // ITEM_BYTES) + 1, size
    while largest > 2 * ITEM_BYTES:
        groups *= 2
        group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
        largest = items.groupBy(group.alias("g")).agg(F.sum(bytes_of).alias("size")).agg(F.max("size")).first()[0]
    return [items.where(group == g) for g in range(groups)]


def _groups(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str):
    """Each group of items with its seeds, ready to be searched for."""
    context = prepare(docs.sparkSession).sparkContext
    for group in _item_groups(benchmark, item_key, item_text):
        held = group.orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in held], [r.text for r in held])
        counted = docs.select(F.col(text).alias("text")).mapInArrow(_counter(context.broadcast(items.distinct)), "at int, n long")
        counts = np.zeros(len(items.distinct), np.int64)
        for r in counted.groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["at"]] = r["n"]
        items.choose_seeds(counts)
        yield context.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document and item with a passage that scores at least the threshold: ``key``, ``item_id``, ``score``,
    and the passage's ``first_word`` and ``last_word`` (counted from 0) in the document."""
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def finder(shared):
        def find(batches):
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                best = best_passages(batch.column(1), shared.value)
                out = [(ids[d], shared.value.ids[i], *v) for (d, i), v in sorted(best.items()) if v[0] >= threshold]
                columns = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "item_id", "score", "first_word", "last_word"])

        return find

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    schema = f"`{key}` long, item_id long, score double, first_word long, last_word long"
    found = [rows.mapInArrow(finder(g), schema) for g in _groups(docs, benchmark, text, item_key, item_text)]
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, that hold no passage of an item at the threshold. Nothing is shuffled."""
    at = docs.columns.index(text)

    def cleaner(shared):
        def clean(batches):
            for batch in slices(batches):
                bad = {d for (d, _), v in best_passages(batch.column(at), shared.value).items() if v[0] >= threshold}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)], pa.bool_()))

        return clean

    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # a map takes no names with dots
    rows = docs.toDF(*plain)
    for group in _groups(docs, benchmark, text, item_key, item_text):
        rows = rows.mapInArrow(cleaner(group), rows.schema)
    return rows.toDF(*names)


def _counter(shared):
    def count(batches):
        look = Lookup(shared.value)
        total = np.zeros(len(look.values), np.int64)
        for batch in slices(batches):
            grams, place = gram_hashes(*word_hashes(batch.column(0)), GRAM, short=True)
            at = look.places(grams)
            owner = np.searchsorted(place, at, side="right") - 1
            pairs = np.unique(owner * np.int64(len(total)) + np.searchsorted(look.values, grams[at])) if len(at) else np.zeros(0, np.int64)
            total += np.bincount(pairs % max(len(total), 1), minlength=len(total)) if len(total) else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": used.astype(np.int32), "n": total[used]})

    return count


def best_passages(texts: pa.Array, items: Items) -> dict[tuple[int, int], tuple[float, int, int]]:
    """For each (text, item) with a seed in common: the best score, and the first and last word of its passage."""
    words, first = word_hashes(texts)
    grams, place = gram_hashes(words, first, GRAM, short=True)
    at = items.lookup().places(grams)
    low, high = (np.searchsorted(items.seeds, grams[at], side=side) for side in ("left", "right"))
    hit = np.repeat(at, high - low)
    seed = np.repeat(low, high - low) + np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    doc = np.searchsorted(place, hit, side="right") - 1
    begin = hit - place[:-1][doc] - items.seed_at[seed]  # where the item would begin in the text
    by_item: dict[int, list] = {}
    for p in _passages(doc, items.seed_item[seed], begin, items, np.diff(first)):
        by_item.setdefault(p[1], []).append(p)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for item, passages in by_item.items():
        own = items.of(item)
        for a in range(0, len(passages), 256):
            some = passages[a : a + 256]
            wide = np.zeros((len(some), max(e - s for _, _, s, e in some)), np.uint64)
            for k, (d, _, s, e) in enumerate(some):
                wide[k, : e - s] = words[first[d] + s : first[d] + e]
            for (d, _, s, e), score in zip(some, align(own, wide) / (2 * len(own))):
                if score > best.get((d, item), (0.0,))[0]:
                    best[d, item] = (float(score), s, e - 1)
    return best


def _passages(doc: np.ndarray, item: np.ndarray, begin: np.ndarray, items: Items, lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Windows (document, item, first word, end) around hits; hits of an item whose windows meet share one."""
    out: list[tuple[int, int, int, int]] = []
    order = np.lexsort((begin, item, doc))
    sizes = np.diff(items.first)
    for d, i, b in zip(doc[order].tolist(), item[order].tolist(), begin[order].tolist()):
        size = int(sizes[i])
        s, e = max(0, b - size // 2 - 2), min(int(lengths[d]), b + size + size // 2 + 2)
        if out and out[-1][:2] == (d, i) and s <= out[-1][3]:
            out[-1] = (d, i, out[-1][2], max(e, out[-1][3]))
        elif e > s:
            out.append((d, i, s, e))
    return out
