"""The explorer's report and tree: plans, files and edges that the queries do not show."""

import pytest
from pyspark.sql import functions as F

from ludograph.operators import explorer as E
from ludograph.operators.sequences import first_visit, position_index, with_child
from ludograph.plans.tables import Store, Tables

KEYS = "hash long, move string, game_id long, ply int, result int, elo int, year int"


def index(spark, rows):
    return spark.createDataFrame(rows, KEYS)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_report_reads_the_index_once(spark, tmp_path):
    index(spark, [(1, "a", 1, 0, 1, 1500, 2000)]).write.parquet(str(tmp_path / "p"))
    report = E.explorer_report(spark.read.parquet(str(tmp_path / "p")), k=3, end="END")
    assert scans(report) == 1
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 2


def test_report_of_missing_values_ties_and_games(spark):
    rows = [(1, "b", 1, 0, 1, None, 2000), (1, "a", 2, 0, 2, 1500, None), (1, "a", 3, 0, 3, 1500, 1999), (1, "b", 4, 0, 9, 1400, 2000),
            (1, "END", 5, 0, 1, None, None), (2, "END", 6, 4, 1, 1, 1)]
    shown = spark.createDataFrame([(1, "one"), (3, "three")], "game_id long, white string")
    names = {"a": "Z", "b": "Y"}
    text = lambda m: F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), m)
    got = {r["hash"]: r for r in E.explorer_report(index(spark, rows), k=4, end="END", text=text, games=shown).collect()}
    assert [(m["text"], m["move"], m["games"]) for m in got[1]["moves"]] == [("Y", "b", 2), ("Z", "a", 2)]
    assert [(g["game_id"], g["white"]) for g in got[1]["top_games"]] == [(3, "three"), (2, None), (4, None), (5, None)]
    assert [(g["game_id"], g["white"]) for g in got[1]["recent_games"]] == [(4, None), (1, "one"), (3, "three"), (5, None)]
    assert (got[1]["games"], got[1]["ended"], got[2]["moves"], got[2]["games"]) == (5, 1, [], 1)
    none = E.explorer_report(index(spark, rows), k=0, end="END").collect()
    assert all(r["top_games"] == [] and r["recent_games"] == [] for r in none)
    assert E.explorer_report(index(spark, []), end="END", games=shown).collect() == []


@pytest.fixture(scope="module")
def plies(spark):
    """Counting games: game g steps up by one or two from 0."""
    rows = []
    for g in range(200):
        at = 0
        for ply in range(12):
            step = 1 + (g >> (ply % 8)) % 2
            rows.append((g, ply, at, str(step)))
            at += step
        rows.append((g, 12, at, "END"))
    return spark.createDataFrame(rows, "game_id long, ply int, hash long, move string")


def test_child(spark, plies):
    rows = with_child(plies, ["game_id"], 5)
    assert rows.agg(F.max("ply")).first()[0] == 5
    assert rows.where(F.col("child") != F.col("hash") + F.col("move").cast("long")).count() == 0
    assert rows.where("child is null").count() == 0 and with_child(plies, ["game_id"], 60).where("child is null and move != 'END'").count() == 0


def tree(plies, depth, breadth):
    table = {}
    for r in plies.collect():
        if r["move"] != "END":
            table.setdefault(r["hash"], {}).setdefault(r["move"], set()).add(r["game_id"])
    out, level = {}, {0}
    for n in range(1, depth + 1):
        after = set()
        for h in level:
            for rank, (move, games) in enumerate(sorted(table.get(h, {}).items(), key=lambda m: (-len(m[1]), m[0]))[:breadth], 1):
                out.setdefault((h, move, len(games), rank), n)
                after.add(h + int(move))
        level = after
    return sorted((*k, n) for k, n in out.items())


def test_tree_opens_files_of_open_states_only(spark, plies, tmp_path):
    games = plies.select("game_id").distinct().select("game_id", F.lit(1).alias("result"), F.lit(2000).alias("elo"), F.lit(2020).alias("year"))
    pos = position_index(first_visit(with_child(plies, ["game_id"]), ["game_id"]), games)
    store = Store(spark, str(tmp_path / "db"))
    store.append(Tables(games.select(F.col("game_id").alias("id"), F.col("year").alias("date"), "result", "elo"), pos))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # so small a table would be one file
    try:
        table = store.explorer_table()
    finally:
        spark.conf.set(merging, "true")
    for depth, breadth in ((1, 1), (3, 2), (5, 1)):
        got = sorted((r["hash"], r["move"], r["games"], r["rank"], r["level"]) for r in table.tree(0, depth, breadth, "END").collect())
        assert got == tree(plies, depth, breadth)
    assert table.keys().count() > 1
    opened = table.of(spark.createDataFrame([(0,), (1,)], "hash long"))
    assert len(opened.inputFiles()) < table.keys().count() and opened.select("hash").distinct().count() == 2
    assert table.of(spark.createDataFrame([(-5,)], "hash long")).count() == 0 and table.tree(-5, 2, 2, "END").count() == 0
    assert table.path == store.explorer_table().path and store.explorer().count() == table.read().count()
