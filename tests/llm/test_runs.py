"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ludograph.llm import queries
from ludograph.llm.common import read_table
from ludograph.llm.periodic_runs import find_runs, runs_of, sorted_suffixes

D = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """For each period the maximal stretches in which words that far apart are equal; smaller periods first."""
    out = []
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= 2 * q:
                part = words[i : i + length]
                smallest = not any(part[k:] == part[:-k] for k in range(1, q))
                if smallest and length >= max(least, times * q):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def codes(words):
    return np.unique(np.array(words), return_inverse=True)[1]


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 2), (9, 4)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for case in range(250):
        n = rng.randrange(2, 120)
        words = [rng.choice("ab" if case % 3 else "abcd") for _ in range(n)]
        if case % 2:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < n else words[a] for i in range(a, n)]
        assert runs_of(codes(words), least, times) == plain_runs(words, least, times), words


def test_suffixes():
    rng = random.Random(1)
    for n in (1, 2, 7, 60):
        words = [rng.choice("ab") for _ in range(n)]
        order, lcp = sorted_suffixes(codes(words))
        assert order.tolist() == sorted(range(n), key=lambda i: words[i:])
        for i, j, k in zip(order[:-1], order[1:], lcp):
            assert words[i : i + k] == words[j : j + k] and words[i : i + k + 1] != words[j : j + k + 1]


def test_edge_cases(spark):
    long = "x y " * 60_000
    rows = [(1, None, "a"), (1, "", "a"), (2, " \t\n", "b"), (3, "w " * 30, "c"), (3, "w " * 30, "c"), (None, long, None),
            (4, "é  " * 24, "d"), (5, "once only " * 5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(find_runs(df).collect(), key=lambda r: (r["doc_id"] or 0, r["text"] or ""))
    assert got[0]["runs"] == [(0, 120_000, 2)] and got[0]["collapsed"] == "x y" and got[0]["n_words"] == 120_000
    assert [(r["doc_id"], r["n_words"], r["runs"], r["collapsed"]) for r in got[1:]] == [
        (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 30, [(0, 30, 1)], "w"), (3, 30, [(0, 30, 1)], "w"),
        (4, 24, [(0, 24, 1)], "é "), (5, 10, [], "once only once only once only once only once only"),
    ]
    assert find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, min_exponent=1)


def test_query(spark):
    want = {}
    for r in read_table(spark, D, "documents").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        drop = {i for s, k, q in runs for i in range(s + q, s + k)}
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        want[r["doc_id"]] = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
        )
    got = queries.QUERIES["op11_periodic_runs"](spark, D).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sum(w[0] > 0 for w in want.values()) > 15
