"""URL filter, byte BPE, token files and WARC against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from ludograph.llm import queries
from ludograph.llm.byte_bpe import ByteBpe, decode_ids, encode_and_decode, encode_texts
from ludograph.llm.common import Recent
from ludograph.llm.elias_fano import EliasFano
from ludograph.llm.token_files import TextEncoder, TokenFile, read_token_files, write_token_files
from ludograph.llm.url_filter import judge_urls
from ludograph.llm.warc import candidates, make_record, manifest_of, read_warc, write_warc

D = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "  a  b ", "don't  stop\n\n now", "x" * 700, "\u00e9\u0301 e\u0301 \u0958 \u1e9b\u0323", "a\x1cb \x1c c", "<|endoftext|> <|endoftext|>x",
    "naïve Straße ΣΑΣ ς", "tab\t space \n", "漢字かな 12345 ½²", "same text", "same text", "İstanbul ﬁ", "it's we'll 'S", "\u2003wide \u00a0 no-break", "😀👍🏽 ok",
    "\r\n \r\n", "word" * 3 + "!!!???" + " ...", "a" * 50 + " " + "ab" * 60,
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    compare(spark, connect(D), name, queries.QUERIES[name], queries.ORACLE[name], D)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "http://net", "http://net/?q", "https://a.example.net/en/x#y", "https://example.net/en",
            "http://xnet/", "http://a.b.org/fr/", "http://org/fr?x", "HTTP://Example.COM/de/", "http://example.com/DE/", "a://b://c/d", "x://", "http://net:80/"]
    df = spark.createDataFrame([(i, u, "mine", i) for i, u in enumerate(urls + urls)], "page_id int, url string, verdict string, found int")
    assert all(r.found == r.page_id for r in judge_urls(df, queries.URL_RULES).collect())
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, queries.URL_RULES).collect()}
    want = set()
    for i, u in enumerate(urls + urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.lower()
        fits = [(len(h), len(p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.add((i, host, path, *(max(fits)[2:] if fits else (None, "allow"))))
    assert got == want
    assert judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    mixed = judge_urls(df, [("net", "", "block"), ("net", "/x", "allow"), ("net", "/x", "block"), ("", "/", "allow")]).collect()
    assert {r.page_id: r.rule for r in mixed}[3] == "net/x" and {r.page_id: r.verdict for r in mixed}[3] == "block"
    with pytest.raises(ValueError):
        judge_urls(df, queries.URL_RULES, max_rules=2)


def bpe_texts():
    rng = random.Random(5)
    alphabet = "aabcdeeist  '\nß漢é1!"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(150)] + ["".join(rng.choice("etaoin") for _ in range(1500))]


def test_byte_bpe_as_the_library(spark):
    import tiktoken

    ranks = queries.content(queries.RANKS)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = bpe_texts()
    encoded = encode_texts(docs(spark, texts), ranks, P.PATTERN)
    rows = decode_ids(encoded, ranks, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id // 3] or ""
        assert r.ids == library.encode_ordinary(text), text
        assert bytes(r.decoded) == text.encode()
    assert encode_texts(docs(spark).limit(0), ranks, P.PATTERN).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id int, ids array<int>")
    assert [len(r.decoded) for r in decode_ids(lists, ranks, P.PATTERN).orderBy("doc_id").collect()] == [0, 0, 2]
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode_ids(spark.createDataFrame([(1, [99999])], "doc_id int, ids array<int>"), ranks, P.PATTERN).collect()


def test_long_words(spark):
    """A word of any length takes a step for each rank that occurs, with the same ids."""
    import tiktoken

    ranks = queries.content(queries.RANKS)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(4)
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(399, 900))) for letters in
            ("ab", "aab", "abcde", "etaoinshrdlu", "éüa", "aeé中文字ñ", "0123456789", "+-*/.") for _ in range(6)]
    tool = ByteBpe(ranks, P.PATTERN)
    for text in made:
        assert tool.encode([text])[0].tolist() == library.encode_ordinary(text)
    longest = "a" * 100_000 + " " + "ab" * 50_000
    row = encode_and_decode(docs(spark, [longest, None]).drop("ids"), ranks, P.PATTERN).orderBy("doc_id").collect()
    assert bytes(row[0].decoded).decode() == longest and len(row[0].ids) == 75_000 and row[1].ids == []
    assert row[0].ids[:20] == library.encode_ordinary("a" * 5000)[:20]


def test_other_tokenizers_go_whole(spark):
    """Only of a tokenizer known to drop white space texts are cut."""
    from tokenizers import Tokenizer

    model = queries.content(queries.BYTE_BPE).decode()
    tool = Tokenizer.from_str(model)
    texts = ["two  words", " a b", "x,y. z", None]
    rows = read_token_files(write_token_files(docs(spark, texts), model, 1)).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == [tool.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_archives_are_read_by_many_tasks(spark):
    rows = [(i, "u", "x" * 3000 + str(i), "f", "s") for i in range(400)]
    manifest = write_warc(pages(spark, rows).coalesce(1), max_file=200_000)
    records = read_warc(manifest, block=20_000, payloads=False)
    tasks = records.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) >= 6


def test_byte_bpe_query(spark):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.content(queries.RANKS).splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    got = {r.doc_id: r for r in queries.QUERIES["op4_byte_bpe"](spark, D).collect()}
    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = library.encode_ordinary(r.text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want


def plain_ids(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_BPE)
    return [tool.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_token_rows(rows, keys, texts):
    want, start = [], 0
    for (key, _), ids in zip(sorted(zip(keys, range(len(keys)))), plain_ids([texts[i] for _, i in sorted(zip(keys, range(len(keys))))])):
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows) == want


def test_token_files(spark):
    texts = bpe_texts()
    manifest = write_token_files(docs(spark, texts), queries.content(queries.WORD_BPE).decode(), 1, max_ids=900)
    rows = read_token_files(manifest, window=50).collect()
    check_token_rows([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows], [i * 3 for i in range(len(texts))], texts)
    assert [list(r.ids) for r in sorted(rows, key=lambda r: r.doc_id)] == plain_ids(texts)
    one = manifest.orderBy("before").first()
    file = TokenFile(one.path)
    assert file.document(1).tolist() == plain_ids(texts)[1]
    assert one.before == 0 and manifest.count() > 3


def test_token_files_odd_rows(spark):
    df = spark.createDataFrame([(5, "b"), (None, "n"), (5, "a"), (-7, None), (None, "n"), (1 << 62, "z")], "doc_id long, text string")
    model = queries.content(queries.WORD_BPE).decode()
    rows = sorted(read_token_files(write_token_files(df, model, 1)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, -7, 5, 5, 1 << 62]
    assert [r.start for r in rows] == [0, 2, 4, 5, 7, 9]
    assert read_token_files(write_token_files(df.limit(0), model, 1)).count() == 0


def test_token_files_query(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    got = queries.QUERIES["op6_token_files"](spark, D).collect()
    check_token_rows([tuple(r) for r in got], [r.doc_id for r in rows], [r.text for r in rows])


@pytest.mark.parametrize("values", [[], [7], [0, 0, 0], [-5, -5, 2, 900], list(range(0, 100000, 7)), [0, 1 << 62], [3] * 600 + [1 << 40] * 600])
def test_elias_fano(values):
    coded = EliasFano.loads(EliasFano.of(np.array(values, dtype=np.int64)).dumps())
    assert coded.select(0, len(values)).tolist() == values
    for i in range(0, len(values), max(1, len(values) // 50)):
        assert coded.select(i).tolist() == [values[i]]
        assert coded.select(i, i + 300).tolist() == values[i : i + 300]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000))
    assert len(EliasFano.of(ends).dumps()) * 8 < 20000 * 14


def fake(n):
    return f"<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n" + "x" * n + "\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, first string, sha string")


def test_warc_round_trip(spark):
    texts = [None, "", "a", "a", "ü" * 400, fake(0), fake(30) * 3, "WARC/1.0\r\nContent-Length: 999999999\r\n\r\n", "x" * 5000, fake(3)[3:] * 40, "a", "same", "same"]
    rows = [(i if i != 11 else None, f"http://h/{i}\r\nx" if i % 2 else None, t, "f", "s") for i, t in enumerate(texts)]
    manifest = write_warc(pages(spark, rows).repartition(2), max_file=4000)
    got = read_warc(manifest, block=256).collect()
    assert len(got) == len(texts)
    payloads = {r.record_id: (r.record_type, r.payload, r.refers_to) for r in got}
    for i, t in enumerate(texts):
        name = f"urn:page:{i if i != 11 else ''}"
        kind, payload, refers = payloads[name]
        first = {3: 2, 10: 2, 1: 0, 11: 12}.get(i)
        assert kind == ("response" if first is None else "revisit"), i
        assert refers == (None if first is None else f"urn:page:{first}")
        assert payload is None if first is not None else bytes(payload) == (t or "").encode()
    assert candidates(manifest, 256).count() > len(texts)
    assert read_warc(write_warc(pages(spark, []))).count() == 0
    apart = read_warc(write_warc(pages(spark, rows), min_bytes=3)).collect()
    assert sum(r.record_type == "revisit" for r in apart) == 1


def test_warc_file_cut_short(spark, tmp_path):
    whole = [make_record(i, None, fake(9).encode(), None) for i in range(40)]
    path = str(tmp_path / "cut.warc")
    with open(path, "wb") as f:
        f.write(b"".join(whole)[:-5])
    got = read_warc(manifest_of(spark, [path]), block=300).collect()
    assert sorted(int(r.record_id[9:]) for r in got) == list(range(39))


def test_warc_long_headers(spark, tmp_path):
    # Longer than what is read of a block at first; followed by records that must not be lost.
    urls = ["u", "u" * 65500, "v" * 70000, "w", "x" * 700000, None, "y"]
    rows = [(i, u, f"page {i} " + "WARC/1.1\r\n" * 50, "f", "s") for i, u in enumerate(urls)]
    manifest = write_warc(pages(spark, rows).coalesce(1))
    assert manifest.count() == 1
    for block in (300, 50000, 8 << 20):
        got = {int(r.record_id[9:]): r for r in read_warc(manifest, block=block).collect()}
        assert {i: (r.url, bytes(r.payload).decode()) for i, r in got.items()} == {i: (u or "", t) for i, u, t, *_ in rows}
    path = str(tmp_path / "long.warc")
    with open(path, "wb") as f:
        f.write(b"".join(make_record(i, u, b"x" * i, None) for i, u in enumerate(urls)))
    assert read_warc(manifest_of(spark, [path]), block=1000).count() == len(urls)


@pytest.mark.parametrize("at", ["first", "inner", "end"])
def test_warc_own_file_broken(spark, at):
    rows = [(i, None, "x" * 400 + str(i), "f", "s") for i in range(20)]
    manifest = write_warc(pages(spark, rows).coalesce(1))
    (own,) = manifest.collect()
    path = own.path.removeprefix("file://").removeprefix("file:")
    with open(path, "rb") as f:
        data = f.read()
    places = [i for i in range(len(data)) if data.startswith(b"WARC/1.1\r\n", i)]
    place = {"first": 0, "inner": places[9], "end": None}[at]
    with open(path, "wb") as f:
        f.write(data[:-5] if place is None else data[:place] + b"warc" + data[place + 4 :])
    for block in (300, 8 << 20):
        with pytest.raises(Exception, match="no whole record"):
            read_warc(manifest, block=block).collect()


def test_warc_query(spark):
    rows = spark.read.parquet(f"{D}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op10_warc"](spark, D).collect()}
    first = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    assert len(got) == len(rows)
    for r in rows:
        data = (r.html or "").encode()
        other = first[r.html or ""]
        want = (r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other == r.page_id else "revisit", None if other == r.page_id else other)
        assert tuple(got[r.page_id]) == want


class Recorder:
    """A database connection that notes the statements it gets."""

    def __init__(self, db, seen):
        self.db, self.seen = db, seen

    def __getattr__(self, name):
        call = getattr(self.db, name)
        return (lambda sql: self.seen.append(sql) or call(sql)) if name in ("sql", "execute") else call


def test_short_words_take_one_statement():
    """Words are merged by one query on rows that hold all it needs, without windows; decoding needs no query."""
    tool, seen = ByteBpe(queries.content(queries.RANKS), P.PATTERN), []
    tool._need("merges")
    tool.db = Recorder(tool.db, seen)
    texts = [t or "" for t in bpe_texts() if len(t or "") < 130]
    ids = tool.encode(texts)
    assert seen and len(set(seen)) == 1 and " over " not in seen[0]
    seen.clear()
    assert tool.decode(np.concatenate(ids), np.array([len(i) for i in ids])) == [t.encode() for t in texts] and not seen


class Pattern:
    """A compiled pattern that notes the texts it meets."""

    def __init__(self, pattern, met):
        self.pattern, self.met = pattern, met

    def findall(self, text):
        self.met.append(text)
        return self.pattern.findall(text)


def test_distinct_pieces_of_a_batch_meet_the_pattern_together():
    """Pieces behind blanks are cut by one call for a batch, each once; ids are those of the library, for a part of an array too."""
    import tiktoken

    ranks, met = queries.content(queries.RANKS), []
    tool = ByteBpe(ranks, P.PATTERN)
    tool.cut = Pattern(tool.cut, met)
    texts = ["Kim went, home (now)", "we went, home\n again\n", None, "went, went, went, a\x1cb", ""] * 40
    tool.encode(texts)
    together = [m for m in met if " " in m]
    assert len(together) == 1 and sorted(together[0].split(" ")) == sorted(["", "went,", "home", "(now)", "home\n", "again\n", "a\x1cb"])
    for pattern in (P.PATTERN, r"\s|\S+", "[a-z]+|[^a-z]"):  # the last cuts no word behind a blank with the blank
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        tool, texts = ByteBpe(ranks, pattern), bpe_texts()[:120] + ["a ", " a", "a  b c", " \n", "a \x1cb", "a\n b\n"]
        flat, sizes = tool.encode_column(pa.array(["before", *texts, "behind"], pa.large_string()).slice(1, len(texts)))
        ends = np.cumsum(sizes)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes)] == [library.encode_ordinary(t or "") for t in texts]
        assert [i.tolist() for i in tool.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]
    assert [len(a) for a in tool.encode_column(pa.array([], pa.string()))] == [0, 0]


def test_vocabulary_of_wide_ranks_with_gaps():
    """Ranks that do not fit a step's packed number, and that are no numbers in a row, give the same tokens."""
    lines = [line.split() for line in queries.content(queries.RANKS).splitlines()]
    wide = ByteBpe(b"\n".join(a + b" %d" % (5_000_000 + 3 * int(b)) for a, b in lines), P.PATTERN)
    tool = ByteBpe(queries.content(queries.RANKS), P.PATTERN)
    texts = [t or "" for t in bpe_texts()[:60]]
    ids, other = tool.encode(texts), wide.encode(texts)
    assert all((5_000_000 + 3 * a == b).all() and len(a) == len(b) for a, b in zip(ids, other))
    assert wide.decode(np.concatenate(other), np.array([len(i) for i in other])) == [t.encode() for t in texts]
    for bad in (5_000_001, 4, 1 << 30):
        with pytest.raises(ValueError, match="not in the vocabulary"):
            wide.decode(np.array([5_000_000, bad], np.int32), np.array([2]))
    with pytest.raises(ValueError, match="not in the vocabulary"):
        tool.decode(np.array([-1], np.int32), np.array([1]))


def test_lookup_over_generations():
    """Keys of the lists are found whatever was forgotten meanwhile; only keys that are not held are worked out."""
    made = []
    recent = Recent(lambda keys: made.extend(keys) or [k * 2 for k in keys], 6)
    for lists in ([["a", "b"], ["b", "c", "a"]], [["a", "d"]], [["a", "b", "e", "f"], ["g", "c"], []], [["h", "a", "i", "j", "k", "l", "m", "n"]]):
        get = recent.lookup(lists)
        assert [[get(k) for k in keys] for keys in lists] == [[k * 2 for k in keys] for keys in lists]
    assert sorted(made) == sorted(set(made)) == list("abcdefghijklmn")


def test_pieces_of_letters_skip_the_pattern(monkeypatch):
    """Pieces of letters only are words themselves; the others meet the pattern; ids are those of the library."""
    from tokenizers import Tokenizer

    model = queries.content(queries.WORD_BPE).decode()
    tool, library = TextEncoder(model), Tokenizer.from_str(model)
    met = []
    shape = tool.shape

    class Shape:
        fullmatch = staticmethod(lambda p: met.append(p) or shape.fullmatch(p))

    tool.shape = Shape
    texts = ["Kim went, home (now)", "ünïcode straße, ΣΑΣ x", "<|endoftext|> a<|b", "don't 12 a1 ２ ①", "éa", ""]
    assert [np.frombuffer(b, tool.kind).tolist() for b in tool.encode(texts)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(p.isalpha() for p in met)
