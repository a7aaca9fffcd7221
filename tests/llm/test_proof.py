"""Classifiers and vector search against plain versions; recall on the given tables with planted partners."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ludograph.llm import quality as Q
from ludograph.llm import toxicity as T
from ludograph.llm.common import read_table
from ludograph.llm.labelled import training_rows
from ludograph.llm.vector_dedup import dedup_vectors
from ludograph.llm.weighted_minhash import dedup_texts

D = "/root/testdata/sf0.001"


def some_texts(spark, n=150):
    rows = [r.text for r in read_table(spark, D, "documents").orderBy("doc_id").select("text").limit(n).collect()]
    return [None, "", "a", "ab", "é", "x" * 9000, *rows]


def test_toxicity_scores_are_mean_vectors_times_softmax(spark):
    """The shipped table of products equals averaging the n-grams' entries one text at a time."""
    rng = np.random.default_rng(1)
    table, bias = rng.normal(size=T.BUCKETS).astype(np.float32), 0.37
    texts = some_texts(spark)
    got = T.logits(pa.array(texts, pa.string()), table, bias)
    want = []
    for t in texts:
        used, share = T.features(t or "")
        want.append(float(np.dot(table[used].astype(np.float64), share.astype(np.float64))) + bias)
    assert np.allclose(got, want, atol=2e-4)


def test_toxicity_training_follows_the_gradient():
    """Learned numbers tell two kinds of bags apart, and equal a plain softmax on the same mean vectors."""
    rng = np.random.default_rng(2)
    kinds = [np.arange(0, 40), np.arange(60, 100)]
    bags, labels = [], []
    for i in range(120):
        used = np.sort(rng.choice(kinds[i % 2], 12, replace=False)).astype(np.int32)
        bags.append((used, np.full(12, 1 / 12, np.float16)))
        labels.append(i % 2)
    table, bias = T.train(bags, np.array(labels, float), steps=150)
    scores = np.array([table[u] @ s.astype(np.float32) + bias for u, s in bags])
    assert ((scores > 0) == (np.array(labels) == 1)).all()
    again, _ = T.train(bags, np.array(labels, float), steps=150)
    assert (again == table).all() and table[kinds[1]].min() > 0 > table[kinds[0]].max()


def test_votes_are_those_of_the_nearest_neighbours(spark):
    docs = read_table(spark, D, "documents").select("doc_id", "text")
    model = Q.fit_quality(docs, read_table(spark, D, "labels"))
    texts = some_texts(spark, 60)
    got = Q.vote(pa.array(texts, pa.string()), model)
    for t, score in zip(texts, got):
        x = Q.weigh(Q.counts_of(pa.array([t], pa.string())), model["idf"])[0].astype(np.float64) @ model["axes"].astype(np.float64)
        if not np.linalg.norm(x):
            assert score == np.float64(model["label"].mean())
            continue
        cosines = sorted(((float(x @ v / np.linalg.norm(x)), float(y)) for v, y in zip(model["near"].astype(np.float64), model["label"])), reverse=True)
        best = cosines[: Q.NEIGHBOURS]
        want = sum(max(c, 0) * y for c, y in best) / sum(max(c, 0) for c, _ in best)
        assert abs(want - score) < 2e-3


def test_contradicting_labels(spark):
    """Of labels that contradict each other for one id, 1 counts; null and other values are no labels."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0, None), (2, 1, None), (3, 0, None), (3, None, None), (4, 7, None)], "doc_id long, toxic int, quality int")
    rows = {r["doc_id"]: r["label"] for r in training_rows(docs, labels, "toxic", 30).collect()}
    assert {k: v for k, v in rows.items() if k in (2, 3, 4)} == {k: v for k, v in {2: 1.0, 3: 0.0}.items() if k in rows} and 4 not in rows


def test_recall_beside_the_given_vectors(spark):
    """Partners at cosines of 0.98 to 0.99 beside every fifth vector of the table, against all pairs of equal label."""
    rng = np.random.default_rng(9)
    rows = [(r.vec_id, r.embedding, r.label) for r in read_table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    top = max(r[0] for r in rows) + 1
    for k, (_, v, label) in enumerate(rows[::5]):
        x = np.array(v) / np.linalg.norm(v)
        other = rng.normal(size=len(x))
        other -= other @ x * x
        c = rng.uniform(0.9805, 0.99)
        rows.append((top + k, (c * x + np.sqrt(1 - c * c) * other / np.linalg.norm(other)).tolist(), label))
    df = spark.createDataFrame([(i, [float(a) for a in v], y, "x", 0) for i, v, y in rows],
                               "vec_id long, embedding array<double>, label int, pivot string, n_links int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in dedup_vectors(df).collect()}
    links, right = 0, 0
    for label in {y for *_, y in rows if y is not None}:
        own = [(i, v) for i, v, y in rows if y == label]
        x = np.array([v for _, v in own], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.98).sum(axis=1) - 1
        links += int(near.sum())
        right += sum(min(found[i][0], n) for (i, _), n in zip(own, near.tolist()))
        assert all(found[i][0] <= n for (i, _), n in zip(own, near.tolist()))
    assert links > 200 and right >= 0.9 * links


def test_recall_of_edited_documents(spark):
    """Copies with a few words changed, planted beside the documents: those still at 0.8 or more by plain count join."""
    docs = read_table(spark, D, "documents").select("doc_id", "text").where("size(split(text, ' ')) between 150 and 400").orderBy("doc_id").limit(60)
    rng = np.random.default_rng(4)
    rows, partner = [], {}
    for r in docs.collect():
        ws = r.text.split(" ")
        at = rng.choice(len(ws), 2, replace=False)
        rows.append((r.doc_id, r.text, "a"))
        partner[10_000_000 + r.doc_id] = r.doc_id
        rows.append((10_000_000 + r.doc_id, " ".join(f"changed{i}" if i in at else w for i, w in enumerate(ws)), "b"))
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    groups = {r.doc_id: r.component_id for r in dedup_texts(all_rows.select("doc_id", "text")).collect()}
    caught = sum(groups[a] == groups[b] for a, b in partner.items())
    assert caught >= 0.9 * len(partner) and len(partner) >= 20
