"""Splitting hot keys changes nothing in the results."""

import random

from pyspark.sql import functions as F

from ludograph.operators.sequences import states, with_next
from ludograph.operators.skew import hot_keys, numbered, running, top_k


def lines(spark, n=3000):
    rng = random.Random(7)
    # One key holds a third of all rows.
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), i, rng.choice("abc"), rng.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, step string, v int").repartition(5)


def test_running(spark):
    df = lines(spark)
    what = dict(
        sums={"s": F.col("v")}, xors={"x": F.col("v").cast("bigint")}, following={"f": F.when(F.col("v") % 4 != 0, F.col("step"))},
        latest={"l": F.when(F.col("v") % 5 == 0, F.col("v"))},
    )
    plain = running(df, ["k"], ["t"], **what)
    split = running(df, ["k"], ["t"], bucket=F.floor(F.col("t") / 50), min_rows=100, **what)
    assert sorted(plain.collect(), key=str) == sorted(split.select(plain.columns).collect(), key=str)


def test_states(spark):
    df = lines(spark)
    bucket = F.floor(F.col("t") / 64)
    for kw in ({"mode": "path"}, {"mode": "bag"}, {"vocabulary": ["a", "b", "c"]}):
        plain = states(df, ["k"], ["t"], "step", **kw)
        split = states(df, ["k"], ["t"], "step", bucket=bucket, min_rows=50, **kw)
        assert sorted(plain.collect(), key=str) == sorted(split.select(plain.columns).collect(), key=str)
    a = with_next(df, ["k"], ["t"], "step", end="END")
    b = with_next(df, ["k"], ["t"], "step", end="END", bucket=bucket, min_rows=50)
    assert sorted(a.collect(), key=str) == sorted(b.select(a.columns).collect(), key=str)


def test_hot_keys(spark):
    df = lines(spark)
    assert [r["k"] for r in hot_keys(df, ["k"], 500).collect()] == [0]
    sizes = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    for least in (0, 45, 60):  # every key above the limit, however many there are
        assert {r["k"] for r in hot_keys(df, ["k"], least).collect()} == {k for k, n in sizes.items() if n > least}


def test_numbered(spark):
    df = lines(spark).withColumn("seq", (F.col("t") * 7).cast("bigint"))
    rows = numbered(df, "seq", "id", 11, width=100).orderBy("seq").collect()
    assert [r["id"] for r in rows] == list(range(11, 3011))


def test_top_k(spark):
    df = lines(spark)
    got = top_k(df, ["k"], [F.desc("v"), F.desc("t")], 4, salt="t", salts=5).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r["k"], []).append((-r["v"], -r["t"]))
    best = {(k, -v, -t) for k, rows in want.items() for v, t in sorted(rows)[:4]}
    assert {(r["k"], r["v"], r["t"]) for r in got} == best
