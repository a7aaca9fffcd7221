"""Runs of words that repeat with a period: maximal stretches like ``a b a b a b``.

Method: descending-LCP Kruskal. The suffixes of a text's words are sorted, neighbours are joined in order of decreasing
common prefix (LCP) by union-find, and each class keeps its positions in order. Two positions that become neighbours
within a class when it forms at LCP l, at distance d <= l, start a stretch of d + l words with smallest period d, which
no word to the right extends; it is a run if no word to the left does either. Every run shows up so: with period q it
has positions q apart with an LCP of at least q, and no member of their class lies between them, or q would not be the
smallest period.

A run of length n has an LCP of n - q. So texts in which no stretch of ``least_lcp`` words occurs twice have no runs that
are long enough, and joins below that LCP are not needed. Stretches are compared by hash for that first look only.

Each row is worked on alone, without a shuffle. Words are what lies between ASCII white space (``[^\\x20\\x09-\\x0D]+``).
Null and empty texts, or texts of white space only, have no words and no runs. A text of n words takes about 100 n bytes
and n log n steps, if it repeats itself. Repeated rows give repeated results; columns named like a new one are replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludograph.llm.common import prepare, slices
from ludograph.llm.words import gram_hashes, mix

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ADDED = {"n_words": T.LongType(), "runs": T.ArrayType(RUN), "collapsed": T.StringType()}


def least_lcp(min_words: int, min_exponent: int) -> int:
    """The least LCP of two positions of a run that is a period apart, over all periods."""
    return min(max(min_words, min_exponent * q) - q for q in range(1, max(min_words, 1) + 1))


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the LCP of each with the next, by doubling: ranks of stretches of 1, 2, 4 ... words."""
    n = len(codes)
    ranks, width = [np.unique(codes, return_inverse=True)[1].astype(np.int64)], 1
    while width < n and ranks[-1].max() < n - 1:
        key = ranks[-1] * (n + 1)
        key[: n - width] += ranks[-1][width:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        for part in (a, b, lcp):
            part[same] += 1 << level
    return order, lcp


def runs_of(codes: np.ndarray, min_words: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with at least ``min_words`` words and ``min_exponent`` periods."""
    if len(codes) < 2:
        return []
    order, lcp = sorted_suffixes(codes)
    edges = np.flatnonzero(lcp >= least_lcp(min_words, min_exponent))
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        if x not in parent:
            parent[x], members[x] = x, [x]
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v, common in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()):
        u, v = root(u), root(v)
        if len(members[u]) < len(members[v]):
            u, v = v, u
        parent[v], large, small = u, members[u], members.pop(v)
        last = -1
        for i, x in enumerate(small):  # neighbours that were not in one class before
            at = bisect_left(large, x, last + 1)
            beside = [(large[at - 1], x)] if at and at - 1 != last else []
            if at < len(large) and (i + 1 == len(small) or small[i + 1] > large[at]):
                beside.append((x, large[at]))
            large.insert(at, x)
            last = at
            for a, b in beside:
                period = b - a
                length = period + common
                if period <= common and length >= min_words and length >= min_exponent * period:
                    if a == 0 or codes[a - 1] != codes[b - 1]:
                        found.append((a, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _suspects(codes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Texts in which a stretch of ``width`` words may occur twice (all in which one does)."""
    grams, place = gram_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), first, width)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(place))
    keys = grams ^ mix(owner.astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(owner[order[again]])


def runs_of_texts(texts: list[str | None], min_words: int, min_exponent: int):
    """For each text the number of words, its runs, and the words left once repetitions are dropped."""
    words = [(t or "").encode().split() for t in texts]
    first = np.cumsum([0, *map(len, words)])
    flat = pa.array([w for ws in words for w in ws], pa.large_binary())
    codes = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
    runs: list[list] = [[] for _ in texts]
    for d in _suspects(codes, first, least_lcp(min_words, min_exponent)).tolist():
        runs[d] = runs_of(codes[first[d] : first[d + 1]], min_words, min_exponent)
    kept = []
    for ws, rs in zip(words, runs):
        if rs:
            drop = np.zeros(len(ws) + 1, dtype=np.int64)
            for start, length, period in rs:
                drop[start + period] += 1
                drop[start + length] -= 1
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
        kept.append(b" ".join(ws).decode())
    return np.diff(first), runs, kept


def find_runs(df: DataFrame, text: str = "text", min_words: int = 24, min_exponent: int = 3) -> DataFrame:
    """Add ``n_words``, ``runs`` (in order of start and period) and ``collapsed``: the words, joined by one blank,
    without those that a run holds after its first period. ``min_exponent`` is 2 or more."""
    if min_exponent < 2 or min_words < 2:
        raise ValueError("a run has two words and two periods at least")
    if text in ADDED:
        raise ValueError(f"the text column may not be named {text}")
    prepare(df.sparkSession)
    rest = df.drop(*ADDED)
    at = rest.columns.index(text)
    schema = T.StructType([*rest.schema.fields, *[T.StructField(c, t) for c, t in ADDED.items()]])

    def work(batches):
        for batch in slices(batches):
            n, runs, kept = runs_of_texts(batch.column(at).to_pylist(), min_words, min_exponent)
            flat = np.array([r for rs in runs for r in rs], dtype=np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"])
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            columns = [*batch.columns, pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, structs), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(work, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; the first of equal ones; null without runs."""
    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.reduce(runs, F.lit(None).cast(RUN), better)

