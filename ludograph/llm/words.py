"""Word hashes of many texts at once, in numpy.

A word is a longest run of ASCII letters, digits and bytes beyond ASCII, in lower case. Everything else separates
words. Equal words have equal 64-bit hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
WINDOW = 1 << 19

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of the texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) <= n:
        size = max(WINDOW * 2, n) + 1
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (one more at the end)."""
    data, offsets = text_bytes(texts)
    heads = np.zeros(len(data) + 1, dtype=bool)
    heads[offsets] = True
    hashes, places = [], []
    at = 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data) and _WORD[data[end - 1]] and _WORD[data[end]] and not heads[end]:  # cut between words
            ahead = data[end : end + WINDOW]
            stops = np.flatnonzero(~_WORD[ahead] | heads[end : end + len(ahead)])
            end += int(stops[0]) if len(stops) else len(ahead)
        part = data[at:end]
        word = _WORD[part]
        edge = heads[at : end + 1]
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | edge[1:-1]
        start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[start]) * down[start]))
        places.append(start + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the place of each text's first run (one more at the end). With
    ``short``, a text of one to n-1 words has one run: all its words."""
    counts = np.diff(first)
    runs = np.maximum(counts - n + 1, 0)
    factor = np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        out *= factor
        out += words[k : len(words) - n + 1 + k]
    starts = np.repeat(first[:-1], runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    grams = mix(out[starts]) if len(starts) else np.zeros(0, np.uint64)
    if not short or not ((counts > 0) & (counts < n)).any():
        return grams, np.concatenate([[0], np.cumsum(runs)])
    full = np.concatenate([[0], np.cumsum(runs)])
    runs = np.where((counts > 0) & (counts < n), 1, runs)
    place = np.concatenate([[0], np.cumsum(runs)])
    merged = np.zeros(place[-1], dtype=np.uint64)
    long = np.repeat(counts >= n, runs)
    merged[long] = grams[: full[-1]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        value = 0
        for w in words[first[d] : first[d + 1]].tolist():
            value = (value * int(factor) + w) % (1 << 64)
        merged[place[d]] = mix(np.array([value ^ 0x5851F42D4C957F2D], dtype=np.uint64))[0]
    return merged, place
