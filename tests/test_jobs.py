"""The native state job and the import on it, against plain counting."""

import random
from collections import Counter

import pytest

from ludograph.operators.explorer import explore
from ludograph.operators.jobs import END, StepCounts
from ludograph.plans.ingest import Options, ingest, rejected
from ludograph.sources.records import records_from_text

WORDS = ("look", "buy", "leave")


def texts(n=30):
    rng = random.Random(3)
    out = []
    for i in range(n):
        steps = [rng.choice(WORDS) for _ in range(rng.randrange(0, 9))]
        out.append((steps, f'[Event "e{i % 4}"]\n[White "w{i}"]\n[Result "1-0"]\n\n1. ' + " ".join(steps) + " 1-0"))
    return out


def plain_states(steps, horizon=60):
    rows = []
    for i, step in enumerate([*steps, END][: horizon + 1]):
        rows.append(("|".join(str(Counter(steps[:i])[w]) for w in WORDS), i, step))
    return rows


@pytest.mark.parametrize("min_rows", [1_000_000, 3])
def test_state_rows(spark, min_rows):
    given = [(k, s) for k, (s, _) in enumerate(texts())] + [(900, [WORDS[i % 3] for i in range(2500)]), (901, None)]
    games = spark.createDataFrame(given, "k long, moves array<string>").repartition(3)
    got = StepCounts(WORDS, min_rows).state_rows(games, ["k"], 3000)
    want = sorted((k, *row) for k, s in given for row in plain_states(s or [], 3000))
    assert sorted((r["k"], r["hash"], r["ply"], r["move"]) for r in got.collect()) == want
    assert StepCounts(WORDS).state_rows(games.limit(0), ["k"], 9).count() == 0


def test_keys_do_not_depend_on_order(spark):
    job = StepCounts()
    games = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["b", "b"])], "k long, moves array<string>")
    last = {r["k"]: r["hash"] for r in job.state_rows(games, ["k"], 60).where(f"move = '{END}'").collect()}
    assert last[1] == last[2] != last[3]
    typed = spark.range(1).select(job.state_of(["a", "b"]).alias("s"), job.state_of([]).alias("none")).first()
    assert typed["s"] == last[1] and typed["none"] == 0


def test_import(spark):
    given = texts()
    records = records_from_text(spark, ["\n\n".join(t for _, t in given)])
    lines = spark.createDataFrame([("A", "two looks", "look look"), ("B", "bought", "1. buy"), ("C", "all", "leave buy look")], "eco string, name string, moves string")
    job = StepCounts(WORDS)
    done = ingest(records, job.named(lines), Options(horizon=4), states=job)
    games = {r["white"]: r for r in done.games.collect()}
    assert len(games) == len(given)
    names = {"2|0|0": "two looks", "0|1|0": "bought", "1|1|1": "all"}
    for i, (steps, _) in enumerate(given):
        r = games[f"w{i}"]
        assert r["moves"] == steps and r["ply_count"] == len(steps)
        hits = [names[s] for s, ply, _ in plain_states(steps, 400) if ply and s in names]
        assert r["opening"] == (hits[-1] if hits else None)
    ids = {r["id"]: r["white"] for r in games.values()}
    got = sorted((ids[r["game_id"]], r["hash"], r["ply"], r["move"]) for r in done.positions.collect())
    assert got == sorted((f"w{i}", *row) for i, (s, _) in enumerate(given) for row in plain_states(s, 4))
    table = {r["move"]: r["games"] for r in explore(done.positions, job.state_of(["look"])).collect()}
    assert table == Counter(step for s, _ in given for state, _, step in plain_states(s, 4) if state == "1|0|0")


def test_unknown_steps_and_rejects(spark):
    records = records_from_text(spark, ['[Event "a"]\n[White "x"]\n\nlook jump buy *', "*"])
    done = ingest(records, states=StepCounts(WORDS))
    assert [r["moves"] for r in done.games.collect()] == [["look"]]
    told = {r["status"]: r for r in done.statuses.collect()}
    assert told["ok"]["warning"] == 'unknown step "jump" at ply 2' and told["error"]["message"].startswith("not a record")
    bad = rejected(done.statuses, records).collect()
    assert len(bad) == 1 and bad[0]["raw"].strip() == "*" and bad[0]["file"] is not None and bad[0]["line"] is not None
    free = ingest(records, states=StepCounts())
    assert [r["moves"] for r in free.games.collect()] == [["look", "jump", "buy"]]
