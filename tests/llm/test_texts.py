"""Near duplicates, decontamination, classifiers, separator scan, vectors and the pipeline against plain versions."""

import collections
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ludograph.llm import decontaminate, queries
from ludograph.llm import weighted_minhash as M
from ludograph.llm.common import among, dealt, staged
from ludograph.llm.decontaminate import align, find_leaks, without_leaks
from ludograph.llm.labelled import training_rows
from ludograph.llm.quality import fit_quality, score_quality
from ludograph.llm.separators import count_tokens, write_flat_tokens
from ludograph.llm import toxicity
from ludograph.llm.toxicity import fit_toxicity, score_toxicity
from ludograph.llm.vector_dedup import dedup_vectors
from ludograph.llm.words import gram_hashes, word_hashes

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, kept string"


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "s", "k") for i, t in enumerate(texts)], SCHEMA)


def tokens_of(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def test_word_hashes():
    texts = [None, "", "a b", "b, A!", "x" * 9, "-", "b a"]
    h, first = word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [0, 0, 2, 2, 1, 0, 2]
    assert h[0] == h[3] == h[6] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 3
    grams, place = gram_hashes(h, first, 2, short=True)
    assert np.diff(place).tolist() == [0, 0, 1, 1, 1, 0, 1] and grams[1] == grams[3] != grams[0]
    long = pa.array(["ab " * 400_000, "y" * 1_300_000 + " ab"])
    h, first = word_hashes(long)
    assert np.diff(first).tolist() == [400_000, 2] and h[0] == h[399_999] == h[-1]


def plain_components(texts, idf):
    n = len(texts)
    bags = []
    for t in texts:
        ws = tokens_of(t or "")
        hashes, _ = word_hashes(pa.array([" ".join(ws)]))
        weight = dict(zip(ws, idf[M.buckets_of(hashes)].tolist()))
        runs = [tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))] if ws else []
        bags.append({r: c * round(sum(weight[w] for w in r) / len(r), 4) for r, c in collections.Counter(runs).items()})
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            both = sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())
            total = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (total and both / total >= 0.8) or (not total and texts[i] == texts[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_weighted_minhash(spark):
    rng = random.Random(3)
    base, other = words(rng, 160), words(rng, 60)
    texts = [None, "", "", "!!", "?", "short one", "Short, one", None]
    for k in range(120):  # near copies around the threshold
        t = list(base)
        for _ in range(k % 6):
            t[rng.randrange(len(t))] = f"e{k}"
        texts.append(" ".join(t))
    texts += [" ".join(words(rng, 80)) for _ in range(40)] + [" ".join(other + words(rng, 40)) for _ in range(30)]
    texts += [texts[20]] * 15 + [" ".join(base * 3), " ".join(base * 3 + ["x"])]
    rng.shuffle(texts)
    df = docs(spark, texts)
    got = {r.doc_id: r for r in M.dedup_texts(df).collect()}
    want = plain_components(texts, M.inverse_frequencies(df))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert M.dedup_texts(df.limit(0)).count() == 0
    odd = M.dedup_texts(docs(spark, ["a b c d e f"] * 3, [4, 4, None])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in odd if r.doc_id) == [(4, 4, True)] * 2 and len(odd) == 3


def test_similarities():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(12)]
    idf = np.ones(M.BUCKETS, np.float32)
    grams, weights, place = M.weighted_shingles(*word_hashes(pa.array(texts)), idf)
    got = M.similarities(grams, weights, place)
    bags = [dict(zip(grams[a:b].tolist(), weights[a:b].tolist())) for a, b in zip(place[:-1], place[1:])]
    for i, x in enumerate(bags):
        for j, y in enumerate(bags):
            both = sum(min(v, y.get(k, 0)) for k, v in x.items())
            total = sum(x.values()) + sum(y.values()) - both
            assert i == j or got[i, j] == pytest.approx(both / total if total else 0)


def test_samples_agree_like_similarity():
    rng = random.Random(2)
    a = words(rng, 3000)
    b = a[:2600] + words(rng, 400)
    grams, weights, place = M.weighted_shingles(*word_hashes(pa.array([" ".join(a), " ".join(b)])), np.full(M.BUCKETS, 2.5, np.float32))
    marks = M.samples(grams, weights, place, 2000)
    assert abs((marks[0] == marks[1]).mean() - M.similarities(grams, weights, place)[0, 1]) < 0.04


def test_query_keeps_one_of_each_text(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op5_weighted_minhash"](spark, D).collect()}
    first = {}
    rows = spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].component_id <= first.setdefault(r.text, r.doc_id)


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_align():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(1, 5, rng.integers(1, 20)).astype(np.uint64), rng.integers(1, 5, (3, rng.integers(1, 30))).astype(np.uint64)
        assert align(a, b).tolist() == [smith_waterman(a.tolist(), r.tolist()) for r in b]


def test_leaks(spark):
    rng = random.Random(8)
    items = [words(rng, 30) for _ in range(6)] + [["two", "words"], [], None, words(rng, 200)]
    texts, want = [None, "", "none of it here"], set()
    for k in range(80):
        i = rng.choice([0, 1, 2, 3, 4, 5, 9])
        t = list(items[i])
        for _ in range(len(t) // 10 * (k % 3)):
            t[rng.randrange(len(t))] = "edited"
        texts.append(" ".join(words(rng, rng.randrange(300)) + t + words(rng, 5)))
    texts += ["Two words!", " ".join(items[0][:8])]
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if item and t and smith_waterman(item, tokens_of(t)) >= len(item):
                want.add((d, i))
    bench = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    df = docs(spark, texts)
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    assert got == want and len(want) > 60
    clean = without_leaks(df, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want} and clean.columns == df.columns
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0
    assert without_leaks(df, bench.limit(0)).count() == len(texts)


def test_query_finds_planted_passages(spark):
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op7_decontaminate"](spark, D).collect()}
    items = [(r.item_id, " ".join(tokens_of(r.text))) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    rows = [(r.doc_id, " ".join(tokens_of(r.text))) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert {(d, i) for d, t in rows for i, x in items if f" {x} " in f" {t} "} <= got


def test_classifiers(spark):
    rng = random.Random(6)
    texts, marks = [], []
    for k in range(500):
        bad = k % 3 == 0
        ws = words(rng, 40)
        for at in range(0, 40, 6) if bad else ():
            ws[at] = rng.choice(["vilest", "rotten", "vermin"])
        texts.append(" ".join(ws) + ("!!! ###" * 9 if k % 2 else ""))
        marks.append((k, int(k % 2 == 0), int(bad)))
    texts += [None, "", " ".join(words(rng, 30) + ["vilesst", "rottenn", "vermiin"] * 3), "x" * 30_000]
    df = docs(spark, texts)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    chosen = training_rows(df, labels, "toxic", 60, 0.3).collect()
    assert len(chosen) == 60 and sum(r.label for r in chosen) == 18
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in chosen)
    for fit, score, column in ((fit_toxicity, score_toxicity, 2), (fit_quality, score_quality, 1)):
        rows = {r.doc_id: r for r in score(df, fit(df, labels)).collect()}
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
        assert np.mean([rows[m[0]].predicted == m[column] for m in marks]) > 0.95
        assert rows[500].score == rows[501].score
        assert rows[502].predicted == 1
        assert score(df.limit(0), fit(df.limit(0), labels)).count() == 0
        none = score(df, fit(df, labels.limit(0))).agg({"predicted": "max"}).first()[0]
        assert none == (0 if column == 2 else 1)


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op8_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    d = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r[label] for r in scored])
    assert len(scored) > 700 and right > 0.95


def test_separator_scan(spark):
    texts = [None, "", "a b c", "word " * 5000, "x", ""] * 3
    ranks = queries.content(queries.RANKS)
    listed = write_flat_tokens(docs(spark, texts), ranks, queries.public_tokenizers.PATTERN, 50256, max_file=9000)
    counted = count_tokens(listed, 50256, block=7)
    sizes = {(r.path, r.ordinal): r for r in counted.collect()}
    rows = listed.collect()
    assert len(rows) == len(texts) == len(sizes) and all(r.closed for r in sizes.values())
    want = {0: 0, 1: 0, 2: 3, 3: 5001, 4: 1, 5: 0}
    assert all(sizes[r.path, r.ordinal].n_tokens == want[r.doc_id % 6] for r in rows)
    assert count_tokens(listed.limit(0), 50256).count() == 0


@pytest.mark.parametrize("ids", [[], [9], [9, 9], [1, 2, 9, 3], [5] * 40, [9] + [5] * 25 + [9, 9, 4]])
def test_separator_scan_of_files(spark, tmp_path, ids):
    path = str(tmp_path / "flat.tok")
    np.array(ids, dtype="<u4").tofile(path)
    files = spark.createDataFrame([(path, len(ids) * 4)], "path string, bytes long")
    got = [(r.n_tokens, r.closed) for r in sorted(count_tokens(files, 9, width=4, block=4).collect(), key=lambda r: r.ordinal)]
    want, n = [], 0
    for x in ids:
        n += 1
        if x == 9:
            want, n = [*want, (n - 1, True)], 0
    assert got == want + [(n, False)] * (n > 0)


def test_blocks_go_to_many_tasks(spark, tmp_path):
    """Blocks are dealt out by the bytes they stand for, however short their rows are."""
    size, block = 400_000, 1000
    paths = [str(tmp_path / f"{i}.tok") for i in range(3)]
    for path in paths:
        np.tile(np.array([*range(7), 99], dtype="<u2"), size // 16).tofile(path)
    files = spark.createDataFrame([(p, size) for p in paths], "path string, bytes long")
    rows = files.selectExpr("path", "bytes", "explode(sequence(0, 199)) as b")
    assert rows.repartition("path", "b").rdd.getNumPartitions() < 4  # merged by adaptive execution
    dealt_out = dealt(rows, F.lit(2 * block), "path", "b", task_bytes=10 * block)
    tasks = dealt_out.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) > 100 and max(r["count"] for r in tasks) < 25
    assert count_tokens(files, 99, block=block).agg({"n_tokens": "sum"}).first()[0] == 3 * 7 * size // 16
    with pytest.raises(Exception, match="whole number of ids"):
        count_tokens(files.selectExpr("path", "bytes - 1 as bytes"), 99).collect()


def test_flat_files_without_ids(spark):
    df = spark.createDataFrame([(None, "a", 1), (0, "b c", 2), (None, None, 3)], "doc_id long, text string, ordinal int")
    listed = write_flat_tokens(df.coalesce(1), queries.content(queries.RANKS), queries.public_tokenizers.PATTERN, 50256)
    assert sorted((r.ordinal, r.doc_id) for r in listed.collect()) == [(0, None), (1, 0), (2, None)]


def test_token_counts_query(spark):
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.content(queries.RANKS).splitlines())}
    tool = tiktoken.Encoding("own", pat_str=queries.public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op1_token_counts"](spark, D).collect()}
    assert got == {r.doc_id: len(tool.encode_ordinary(r.text)) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(40):
        centre = rng.normal(size=16)
        for k in range(1 + (g % 5) * 2):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.05 * (k > 1)).astype(np.float32).tolist(), g % 2))
    rows += [(1000, rows[5][1], None), (1001, None, 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 0), (None, rows[5][1], 0), (1004, [None, 1.0], 0), (1005, [1.0, 2.0], 0),
             (1006, [2.0, 4.0], 0), (1005, [1.0, 2.0], 0), (1007, [], 0), (1008, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = dedup_vectors(df).collect()
    fine = [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = [0] * len(rows)
    root = {i: r[0] for i, r in fine}
    for i, a in fine:
        for j, b in fine:
            x, y = np.array(a[1]), np.array(b[1])
            if i != j and a[2] == b[2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i] += 1
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    want = sorted((r[0] if r[0] is not None else -1, links[i], root.get(i, r[0]) if r[0] is not None else None) for i, r in enumerate(rows))
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in got) == want and max(links) > 5
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert dedup_vectors(df.limit(0)).count() == 0


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    total = spark.read.parquet(f"{D}/documents.parquet").count()
    assert 0.5 * total < len(rows) < total and len({r.doc_id for r in rows}) == len(rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_odd_rows(spark):
    text = "a plain text of more than five words for the stages to keep"
    odd = spark.createDataFrame(
        [(1, text, "en", "a", 1, "s"), (1, text, "en", "a", 1, "s"), (2, text + "!", "en", "a", 1, "s"), (None, text, None, None, None, None), (3, None, "en", "a", 0, "s"), (4, "", "en", "a", 0, "s")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, D).columns == odd.columns
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_distinct(spark, odd, D).collect()]
    assert len(kept) == 4 and set(kept) == {(None, text), (1, text), (3, None), (4, "")}
    assert corpus_pipeline.tokens(spark, odd, D).count() == 6


def test_pipeline_keeps_columns_of_any_name(spark):
    """No stage writes over a column, whatever it is called."""
    text = "a plain text of more than five words for the stages to keep"
    names = ["tx", "tx_", "_tx", "found", "a.b", "row", "key", "n", "hash", "id", "label", "TX__"]
    rows = [(i, f"{text} {i}" * 9, *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, df, D)
        assert kept.columns == df.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


def test_near_distinct_of_repeated_ids(spark):
    """Rows that share an id but not the text are judged one by one."""
    rng = random.Random(5)
    one, two, own = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(5, one), (7, one + " x"), (7, two), (9, two + " y"), (9, own), (9, own.upper() + "!"), (None, one), (7, None), (7, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_distinct(spark, df, D).collect()]
    assert {(5, one), (7, two), (None, one), (7, None)} <= set(kept) and len(kept) == 5
    assert sum(t.lower().startswith(own.lower()) for i, t in kept if i == 9) == 1
    got = {(r.doc_id, r.kept): r.component_id for r in M.dedup_texts(df.where("text is not null")).collect()}
    assert got == {(5, True): 5, (7, False): 5, (7, True): 7, (9, False): got[9, False], (9, True): 9, (None, True): None}
    assert M.dedup_texts(df).columns == ["doc_id", "class_id", "component_id", "kept"]


def shuffled(spark):
    """The shuffle files that there are, and their bytes."""
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f: f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


def test_near_distinct_shuffles_only_texts_of_buckets(spark):
    """With copies among many documents, texts that share no bucket are in no shuffle, also where nothing is broadcast."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("0123456789abcdef", k=4000)) + f" {i} one two three four five" for i in range(600)]
    rows = list(enumerate([*texts, *texts[:6]])) + [(2, texts[2])]
    df = staged(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    before = shuffled(spark)
    kept = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    try:
        for name in kept:
            spark.conf.set(name, "-1")
        got = corpus_pipeline.near_distinct(spark, df, D).collect()
    finally:
        for name in kept:
            spark.conf.unset(name)
    assert sorted((r.doc_id, r.text) for r in got) == list(enumerate(texts))
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < sum(map(len, texts)) / 4


def test_among_is_both_joins(spark, monkeypatch):
    """Rows whose key is listed, and all others, whatever a full table of marks rules out."""
    rows = spark.createDataFrame([(None if i % 50 == 0 else i, i % 7, f"t{i}") for i in range(500)], "`id` long, k int, `a.b` string")
    keys = staged(spark.createDataFrame([(i, i % 7) for i in range(1, 500, 9)] + [(None, 0), (3, 4)], "id long, k long"))
    want = {f"t{i}" for i in range(1, 500, 9) if i % 50}
    for bits in (32, 1 << 26):
        monkeypatch.setattr("ludograph.llm.common.TABLE_BITS", bits)
        found, others = among(rows, keys, ["id", "k"])
        assert found.columns == others.columns == rows.columns
        assert {r["a.b"] for r in found.collect()} == want
        assert sorted(r["a.b"] for r in others.collect()) == sorted({f"t{i}" for i in range(500)} - want)
        found, others = among(rows, staged(keys.limit(0)), ["id", "k"])
        assert found.count() == 0 and others.count() == 500


def test_groups_of_items_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 400)
    rows = [(i, f"item number {i} " * 8) for i in range(40)] + [(7, "item number 7 " * 8)] * 30
    items = spark.createDataFrame(rows, "item_id long, text string")
    groups = [g.collect() for g in decontaminate._item_groups(items, "item_id", "text")]
    assert sum(map(len, groups)) == 40 and max(sum(len(r.text) for r in g) for g in groups) <= 800
    with pytest.raises(ValueError, match="broadcast"):
        decontaminate._item_groups(items.selectExpr("item_id", "repeat(text, 9) as text"), "item_id", "text")


@pytest.mark.parametrize("n,far", [(5000, 1), (1500, 700), (900, 900), (1, 1), (400, 0)])
def test_strays_meet_all_members_once(spark, n, far):
    """Every pair with a far member shares a unit; rows grow with members and chunks of far ones, not with pairs."""
    from ludograph.llm.weighted_minhash import CHUNK, FAR, UNIT, work_units

    ids = F.col("id")
    others = spark.range(n).select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("bucket"), "id", (ids * 3).alias("tx"), (ids < far).alias("far"),
                                   ids.alias("root"), F.lit(1.0).alias("w"), ids.alias("p1"), ids.alias("p2"))
    rows = work_units(others).collect()
    if n < 2 or not far:
        assert rows == []
        return
    units = {}
    for r in rows:
        units.setdefault(tuple(r[c] for c in UNIT), []).append((r["id"], r["far"]))
    met = set()
    for u, members in units.items():
        assert len(members) == len(set(members)) <= 4 * CHUNK
        x = [i for i, f in members if f]
        y = x if u[2] == FAR else [i for i, f in members if not f]
        met.update((i, j) for i in x for j in y)
    assert {(min(p), max(p)) for p in met if p[0] != p[1]} == {(i, j) for i in range(far) for j in range(i + 1, n)}
    fars, rests = -(-far // CHUNK), -(-(n - far) // CHUNK)
    assert len(rows) == far * (fars + rests) + (n - far) * fars


def test_bags_do_not_travel_to_the_driver(spark, monkeypatch):
    """Whatever the length of the texts, training fetches short rows; the bags it reads are those of the texts."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in [0, 1, 4, *[20_000] * 40]]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, toxic int")
    fetched, to_arrow = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: fetched.append(to_arrow(self)) or fetched[-1])
    fit_toxicity(df, labels)
    assert fetched and sum(t.nbytes for t in fetched) < 20_000
    rows = training_rows(df, labels, "toxic", 100, 0.5)
    got = sorted((used.tolist(), share.tolist()) for used, share in toxicity.read_bags(to_arrow(toxicity.write_bags(rows))))
    want = (toxicity.features(r.text) for r in rows.collect())
    assert got == sorted((used.tolist(), share.astype(np.float16).tolist()) for used, share in want)
