"""Alignment of two tokenizers against a plain walk over whole texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ludograph.llm import queries
from ludograph.llm.alignment import align_texts, judge_links, overlaps, pair_counts, shared_cuts
from ludograph.llm.common import Recent, read_table, staged

D = "/root/testdata/sf0.001"


def models():
    return queries.content(queries.BYTE_BPE).decode(), queries.content(queries.PIECE_BPE)


def test_cuts_and_overlaps():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 40)
        a, b = ([*sorted(rng.sample(range(1, n), rng.randrange(n))), n] for _ in "ab")
        both = sorted(set(a) & set(b))
        want = [(a.index(x) + 1, b.index(x) + 1) for x in both]
        known = np.array(sorted({*rng.sample(both, rng.randrange(len(both))), n}))
        for start in (None, known):
            assert list(zip(*[x.tolist() for x in shared_cuts(np.array(a), np.array(b), start)])) == want
        ranges = [[(s, e) for s, e in zip([0, *x], x)] for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e]
        assert list(zip(*[x.tolist() for x in overlaps(np.array(a), np.array(b))[:2]])) == want


def test_cuts_far_from_the_middle():
    a = np.append(np.arange(1, 4000, 2), 4001)
    b = np.sort(np.append(np.arange(2, 4000, 2), [1, 3, 3999, 4001]))
    ends = np.intersect1d(a, b)
    cut_a, cut_b = shared_cuts(a, b)
    assert a[cut_a - 1].tolist() == b[cut_b - 1].tolist() == ends.tolist() == [1, 3, 3999, 4001]


def plain(texts):
    """Whole texts by both libraries, tokens compared byte by byte."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = {}
    spare = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            shown[chr(x)] = x
        else:
            shown[chr(spare)] = x
            spare += 1
    rows = []
    for text in texts:
        of_a = of_b = []
        if text:
            whole = b" " + text.encode()
            code = a.encode(" " + text, add_special_tokens=False)
            of_a = [(i, bytes(shown[c] for c in t)) for i, t in zip(code.ids, code.tokens)]
            of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                    for i in b.encode(text)]
            if any(b"".join(t for _, t in side) != whole for side in (of_a, of_b)):
                of_a = of_b = []
        at = [[n for n, (_, t) in enumerate(side) for _ in t] for side in (of_a, of_b)]
        links = sorted(set(zip(*at)))
        groups, i, j = [], 0, 0
        for x in range(len(at[0])):
            last = x + 1 == len(at[0])
            if last or (at[0][x] != at[0][x + 1] and at[1][x] != at[1][x + 1]):
                k, m = at[0][x] + 1, at[1][x] + 1
                groups.append(",".join(str(n) for n, _ in of_a[i:k]) + "|" + ",".join(str(n) for n, _ in of_b[j:m]))
                i, j = k, m
        rows.append((len(of_a), len(of_b), groups, [(of_a[i][0], of_b[j][0]) for i, j in links]))
    counts = collections.Counter(p for r in rows for p in r[3])
    highest = collections.Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in rows]


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b \nc", "▁x", "a ▁b", "<s> </s> <|endoftext|> <unk> <0x41>",
       "it's we'll  don't", "tab\there", "x  y", "\x00 a", "\x1c b \x1cc", "é ́e", "\U0001f600 \U0001f600\U0001f601 z",
       "12 345 6,7", "中文 字", "\r\n\r\n x", "word " * 3000, "z" * 30_000, "　 a", "a  b", "... !!  ,,", "﻿ a", "ab.\nCd", "a.\n", "\nA", "a\n\nb", "don't,\n(x) \n<0x0A>", "xÀ,ɏ. z̈,y", "a\n▁", "1\n2", "it's\nIT'S"]


def odd_texts(n=400):
    rng = random.Random(12)
    return ODD + ["".join(rng.choice(["a", "the", " ", "  ", "\n", ".", ",", "é", "ß", "1", "'s", "<s>", "\U0001f600", "\t", " "])
                          for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("max_pairs", [0, 1_000_000])
def test_odd_texts(spark, max_pairs):
    texts = odd_texts()
    df = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, links int").repartition(3)
    aligned = staged(align_texts(df, *models(), digest=True))
    got = judge_links(aligned, pair_counts(aligned), max_pairs)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = [(i // 2, *r) for i, r in enumerate(plain(texts))]
    assert sorted(map(tuple, got.select("key", *names).collect())) == sorted(want)


def test_groups_as_text_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two", "k")], "doc_id long, text string, key string")
    r = align_texts(df, *models()).first()
    assert r["key"] is None and r["groups"].count(";") == r["n_groups"] - 1 and r["n_links"] == sum(x["n"] for x in r["links"])
    aligned = staged(align_texts(df.limit(0), *models()))
    assert judge_links(aligned, pair_counts(aligned)).count() == 0


def test_query(spark):
    docs = read_table(spark, D, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, plain([r["text"] for r in docs]))}
    got = queries.QUERIES["op12_token_alignment"](spark, D).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_recent_by_bytes():
    made = []
    table = Recent(lambda ks: made.extend(ks) or [k * 10 for k in ks], 100, lambda k, v: len(v))
    for k in ("a", "b", "c", "a", "d" * 20, "a"):
        assert table.table({k})[k] == k * 10
    assert made.count("a") <= 2 and table.held <= 300
