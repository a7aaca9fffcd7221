"""The stored star schema: names keep their ids, searches on ids equal searches on names, writers do not lose work."""

import itertools

import pytest
from pyspark.sql import functions as F

from ludograph.operators.jobs import StepCounts
from ludograph.operators.search import GameQuery, search
from ludograph.plans.ingest import Options
from ludograph.plans.star import from_star
from ludograph.plans.star_store import StarStore
from ludograph.plans.tables import Store, Tables
from ludograph.sources.records import records_from_text

JOB = StepCounts(("look", "buy"))


def text(rows):
    out = []
    for i, (white, black, event, date, result, steps) in enumerate(rows):
        tags = {"Event": event, "White": white, "Black": black, "Date": date, "Result": result, "WhiteElo": str(1500 + 10 * i)}
        out.append("".join(f'[{k} "{v}"]\n' for k, v in tags.items() if v is not None) + f"\n{steps} {result}\n")
    return "\n".join(out)


FIRST = [("Ada", "Bo", "Spring", "2020.01.02", "1-0", "look buy"), ("bo", "Cy", "Spring", "2020.02.??", "0-1", "buy"),
         ("Cy", "ADA", None, "????.??.??", "1/2-1/2", "look look look"), ("Di", "Ada", "Autumn", "2019.05.06", "1-0", "buy look")]
SECOND = [("Eve", "ada", "SPRING", "2021.01.01", "0-1", "look"), ("Cy", "Fay", "Winter", "2018.01.01", "1-0", "look buy buy"), FIRST[0]]


def records(spark, rows):
    return records_from_text(spark, [text(rows)])


@pytest.fixture(scope="module")
def names(spark):
    lines = spark.createDataFrame([("A1", "Look", "look"), ("B1", "Deal", "buy look")], "eco string, name string, moves string")
    return JOB.named(lines)


@pytest.fixture(scope="module")
def store(spark, names, tmp_path_factory):
    store = StarStore(spark, str(tmp_path_factory.mktemp("star") / "db"))
    store.load(records(spark, FIRST), names, states=JOB)
    return store


@pytest.fixture(scope="module")
def both(spark, store, names):
    before = {d: {r["name"]: r["id"] for r in store.names(d).collect()} for d in ("players", "events", "openings")}
    bad = "*"
    store.load(records_from_text(spark, [text(SECOND), bad]), names, states=JOB)
    return store, before


def test_names_keep_their_ids(both):
    store, before = both
    assert before["players"] == {"Ada": 1, "Bo": 2, "Cy": 3, "Di": 4} and before["events"] == {"Spring": 1, "Autumn": 2}
    players = {r["name"]: r["id"] for r in store.names("players").collect()}
    assert players == before["players"] | {"Eve": 5, "Fay": 6}
    assert {r["name"]: r["id"] for r in store.names("events").collect()} == before["events"] | {"Winter": 3}
    eco = {r["name"]: r["eco"] for r in store.names("openings").collect()}
    assert eco == {"Look": "A1", "Deal": "B1"}
    named = {r["id"]: (r["white"], r["black"], r["event"], r["opening"]) for r in from_star(store.star()).collect()}
    assert len(named) == 6 and named[2] == ("Bo", "Cy", "Spring", None) and named[5] == ("Eve", "Ada", "Spring", "Look")
    assert not {"white", "black", "event", "site", "opening"} & set(store.table("games").columns)


def test_rejects_and_reports(both):
    store, _ = both
    bad = store.rejects().collect()
    assert [(r["batch"], r["message"], r["raw"].strip()) for r in bad] == [(1, "not a record: no tags and no steps", "*")]
    assert bad[0]["file"] is not None and bad[0]["line"] is not None
    reports = [(r["version"], r["imported"], r["duplicates"], r["errors"]) for r in store.reports().collect()]
    assert reports == [(2, 2, 1, 1), (1, 4, 0, 0)]


def test_search_equals_search_by_names(both):
    store, _ = both
    flat = from_star(store.star())
    positions = store.read().positions
    cases = [GameQuery(), GameQuery(player="ada"), GameQuery(player="ada", color="black", result="loss"), GameQuery(player="ADA", result="win", player_exact=True),
             GameQuery(player="a", opponent="bo"), GameQuery(player="c", color="white", opponent="fa"), GameQuery(player="ada", result="draw"),
             GameQuery(event="spring", sort="white", order="asc"), GameQuery(white="c", black="a"), GameQuery(opening="look"), GameQuery(result="1-0", sort="event"),
             GameQuery(sort="black", order="asc", offset=1, limit=2), GameQuery(date_from="2019", date_to="2020.01"), GameQuery(min_elo=1510, sort="date"),
             GameQuery(min_plies=2, eco="A"), GameQuery(state="1|0"), GameQuery(opponent="x"), GameQuery(result="draw"), GameQuery(result="win"),
             GameQuery(player="zzz"), GameQuery(annotated=False, sort="plies", order="asc")]
    for q in cases:
        want = search(flat, q, positions)
        got = store.search(q)
        columns = want.columns
        assert [tuple(r) for r in got.select(columns).collect()] == [tuple(r) for r in want.collect()], q


def test_names_are_joined_after_the_page(both):
    store, _ = both
    plan = store.search(GameQuery(min_elo=1500, sort="date"))._jdf.queryExecution().optimizedPlan().toString()
    limit = plan.index("GlobalLimit")
    assert plan.count("Join") == 5 and all(i < limit for i in range(len(plan)) if plan.startswith("Join", i))


def test_two_writers(spark, names, tmp_path, monkeypatch):
    """A load during which another writer commits is worked out again, with new ids, and nothing is lost."""
    path = str(tmp_path / "db")
    one, two = StarStore(spark, path), StarStore(spark, path)
    one.load(records(spark, FIRST), names, states=JOB)
    commit, calls = one._commit, []

    def late(row):
        if not calls:
            calls.append(two.load(records(spark, SECOND), names, states=JOB))
        return commit(row)

    monkeypatch.setattr(one, "_commit", late)
    third = [("Gil", "Eve", "Winter", "2022.01.01", "1-0", "look"), SECOND[0]]
    assert one.load(records(spark, third), names, states=JOB) == 3 and calls == [2]
    games = from_star(two.star()).collect()
    assert sorted(r["id"] for r in games) == list(range(1, 8)) and sum(r["white"] == "Eve" for r in games) == 1
    players = [r["name"] for r in two.names("players").orderBy("id").collect()]
    assert players == ["Ada", "Bo", "Cy", "Di", "Eve", "Fay", "Gil"] and two.names("players").agg(F.max("id")).first()[0] == 7
    assert two.current()["games"] == 7 and two.current()["positions"] == two.read().positions.count()
    deletes = [StarStore(spark, path) for _ in range(2)]
    inner, done = deletes[0]._commit, []

    def after_other(row):
        if not done:
            done.append(deletes[1].delete(spark.createDataFrame([(1,), (2,)], "id long")))
        return inner(row)

    monkeypatch.setattr(deletes[0], "_commit", after_other)
    deletes[0].delete(spark.createDataFrame([(2,), (3,)], "id long"))
    assert one.current()["games"] == 4 == one.read().games.count() and one.current()["positions"] == one.read().positions.count()


def test_a_batch_is_stored_once(spark, names, tmp_path):
    store = StarStore(spark, str(tmp_path / "db"))
    assert store.load(records(spark, FIRST), names, states=JOB, batch=9) == 1
    assert store.load(records(spark, SECOND), names, states=JOB, batch=9) == 1
    assert store.current()["games"] == 4
    empty = StarStore(spark, str(tmp_path / "none"))
    assert empty.rejects().count() == 0 and empty.reports().count() == 0 and empty.names("openings").count() == 0


def facts(spark, n):
    rows = [(i, 20_000_000 + i * 7919 % 1000 if i % 10 else None, i % 3) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, date int, result int")


def index(spark, n):
    rows = [(i * 31 % 40 if k else -5, k, i, k) for i in range(1, n + 1) for k in range(3)]
    return spark.createDataFrame(rows, "hash long, move int, game_id long, ply int")


@pytest.fixture
def plain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ludograph.plans.tables.by_date", lambda g: g.repartitionByRange(6, "date", "id").sortWithinPartitions("date", "id"))
    monkeypatch.setattr("ludograph.plans.tables.clustered", lambda p: p.repartitionByRange(8, "hash", "move", "game_id").sortWithinPartitions("hash", "move", "game_id"))
    store = Store(spark, str(tmp_path / "db"))
    games, rows = facts(spark, 300), index(spark, 300)
    for a, b in ((0, 200), (200, 300)):
        store.append(Tables(games.where(F.col("id").between(a + 1, b)), rows.where(F.col("game_id").between(a + 1, b))))
    return store


def test_lookups_open_few_files(plain):
    total = plain.files("positions").count()
    assert total > 10 and plain.files("games").agg(F.sum("n")).first()[0] == 300
    for h in (-5, 0, 7, 39, 99):
        rows = plain.state(h)
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.read().positions.where(F.col("hash") == h).collect()))
        assert len(rows.inputFiles()) <= total // 2


def test_a_deletion_reads_no_positions(spark, plain, monkeypatch):
    read = []
    original = plain._table
    monkeypatch.setattr(plain, "_table", lambda name, last: read.append(name) or original(name, last))
    plain.delete(spark.createDataFrame([(i,) for i in range(1, 301, 7)], "id long"))
    assert read == ["sizes"]
    assert plain.current()["games"] == plain.read().games.count() and plain.current()["positions"] == plain.read().positions.count()


def test_paging_by_place(spark, plain):
    plain.delete(spark.createDataFrame([(i,) for i in range(1, 301, 3)], "id long"))
    want = [(r["date"], r["id"]) for r in plain.read().games.orderBy(F.asc_nulls_first("date"), "id").collect()]
    place, got = (None, 0), []
    for _ in itertools.count():
        rows = plain.after(*place, n=23)
        part = [(r["date"], r["id"]) for r in rows.collect()]
        if not part:
            break
        assert len(got) + len(part) == len(want) or len(rows.inputFiles()) < plain.files("games").count()
        got, place = got + part, part[-1]
    assert got == want


def test_horizon_is_fixed(spark, store, names):
    with pytest.raises(ValueError):
        store.load(records(spark, SECOND), names, Options(horizon=5), states=JOB)
