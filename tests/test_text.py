"""Texts with the traps that record files hold."""

import time

import pytest
from pyspark.sql import functions as F

from ludograph.functions import columns as C
from ludograph.functions import text as X
from ludograph.functions import tree as T


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f("t").alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("1. e4 e5 2. Nf3 Nc6", "e4 e5 Nf3 Nc6"),
    ("1.e4 e5 2.Nf3! Nc6?! 3...Bb5+", "e4 e5 Nf3 Nc6 Bb5+"),
    ("1. e4 (1. d4 d5 (1... Nf6 2. c4) 2. c4) 1... e5 ; rest ( of line\n2. Nf3 {a ( b} Nc6", "e4 e5 Nf3 Nc6"),
    ("1. e4 e5 2. Nf3 += Nc6 3. Bb5 +- a6 N $14 *", "e4 e5 Nf3 Nc6 Bb5 a6"),
    ("1. 0-0 0-0-0 O-O-O 0000 -- Z0", "0-0 0-0-0 O-O-O -- -- Z0"),
    ("exf6e.p. exf6 e.p. Kf7", "exf6e.p. exf6 Kf7"),
    ("1. e4 e5 1-0 1. d4 d5", "e4 e5"),
    ("1. e4 {unterminated e5", "e4"),
    ("e4) e5 ) Nf3", "e4 e5 Nf3"),
    ("%not this\ne4 %nor-this-one e5", "e4 e5"),
    ("12e4 ...e5 e8=Q+ bxa1n# g1f3 hello 99  Nf3﻿", "e4 e5 e8=Q+ bxa1n# g1f3 Nf3"),
    ("1. e4 [White \"x\"] e5", "e4"),
    ("", ""),
])
def test_mainline(spark, text, want):
    assert one(spark, text, X.mainline_tokens) == want.split()


@pytest.mark.parametrize("text,want", [
    ("1. e4 1-0", "1-0"), ("e4 (e5 0-1)", None), ("1/2", "1/2-1/2"), ("½-½", "1/2-1/2"), ("0.5-0.5", "1/2-1/2"),
    ("e4 {1-0} *", "*"), ("e4 1-0 e5 0-1", "0-1"), ("e41-0", None),
])
def test_result(spark, text, want):
    assert one(spark, text, X.result_token) == want


def test_tags(spark):
    text = (
        '﻿% typed in\n[Event "Cup \\"Kiel\\" \\\\ [b]"]\r\n[White "Ole "Tau" Berg"]\n[ Site  "pier" ]\n[Round "4"]\n[Round "5"]\n[Empty ""]\n'
        '\n1. c4 {[Not "one"]} c5 *'
    )
    tags = one(spark, text, X.tags)
    assert tags["Event"] == 'Cup "Kiel" \\ [b]'
    assert tags["White"] == 'Ole "Tau" Berg'
    assert tags["Round"] == "5" and tags["Empty"] == "" and tags["Site"] == "pier"
    assert "Not" not in tags
    assert one(spark, text, X.movetext) == '1. c4 {[Not "one"]} c5 *'
    assert one(spark, '[Site "pier 4]"]\n[Board "7"]\n\n1. c4 *\n', X.movetext) == "1. c4 *"
    assert one(spark, "1. e4 *", X.tags) == {}


@pytest.mark.parametrize("text,want", [
    ("[Event Harbour Cup ]\n[White-Title \"GM\"]", {"Event": "Harbour Cup", "White-Title": "GM"}),
    ("[White \"Lund\"] [Black \"Aro\"]", {"White": "Lund", "Black": "Aro"}),
    ("[Site \"quay 9\n[Round 3]", {"Site": "quay 9", "Round": "3"}),
    ("[Site \"a [Board 2] b\"]\n%[Hidden \"x\"]\n[Board\"1\"]", {"Site": "a [Board 2] b", "Board": "1"}),
    ("[Alone]\n[Open", {"Alone": "", "Open": ""}),
    ("[]\n[ \"x\"]", {}),
])
def test_lenient_tags(spark, text, want):
    assert one(spark, text, X.tags) == want


@pytest.mark.parametrize("text,want", [
    ("1. e4 e5", False), ("1. e4! e5", True), ("1. e4 e5 $4", True), ("1. e4 {}", True), ("1. e4 (d4)", True), ("e4 ; x", True),
    ("e4 N", True), ("e4 += e5", True), ("e8=Q", False), ("%! \ne4", False), ("1/2-1/2", False),
])
def test_annotated(spark, text, want):
    assert one(spark, text, X.is_annotated) is want


def test_nags_and_comments(spark):
    text = "1. e4! $3 e5?? {x} 2. Nf3 =+ ;rest\n Nc6 N"
    assert one(spark, text, X.nags) == [1, 3, 4, 15, 146]
    assert one(spark, "{ a\nb } e4 ; c \n{}", X.comments) == ["a\nb", "c", ""]


@pytest.mark.parametrize("text,want", [
    ("1. Nf3 d5 2. g3 * 1. b3 0-1\n\n\n1. f4 f5 1-0", ["Nf3 d5 g3", "b3", "f4 f5"]),
    ("1. b4 e5 0-1 {the clock ran out} ; late\n", ["b4 e5"]),
    ("1. f4 0-1 $5", ["f4"]),
    ("c4 (d4 0-1 (Nf3)) c5 1/2 {0-1} 1-0", ["c4 c5", ""]),
    ("", [""]),
])
def test_split(spark, text, want):
    got = one(spark, text, lambda c: F.transform(X.split_by_result(c), X.mainline_tokens))
    assert [" ".join(g) for g in got] == want


def test_commands(spark):
    c = one(spark, "[%eval -1.20,18] quiet [%clk 0:00:09.5] but [%csl Ra1,Xa2] firm [%cal Bh1h8]", X.comment_commands)
    assert (c["text"], c["clock"], c["eval"]) == ("quiet but firm", "00:09", "-1.20")
    assert [tuple(a) for a in c["arrows"]] == [("#003088", "h1", "h8")]
    assert [tuple(a) for a in c["highlights"]] == [("#882020", "a1")]
    c = one(spark, "[%clk 2:15:07]", X.comment_commands)
    assert c["text"] == "" and c["clock"] == "2:15:07" and c["eval"] is None


def test_tree(spark):
    nodes = one(spark, "{first} 1. c4 {wide} 1... e5 (1... c5 $6 2. g3 (2. b3?)) ({quiet} 1... b6) 2. Nc3 *", T.tree)
    got = [(n["node"], n["parent"], n["variation"], n["depth"], n["ply"], n["san"], n["child_ix"]) for n in nodes]
    assert got == [
        (1, 0, 0, 0, 1, "c4", 0), (2, 1, 0, 0, 2, "e5", 0), (3, 1, 1, 1, 2, "c5", 1), (4, 3, 1, 1, 3, "g3", 0),
        (5, 3, 2, 2, 3, "b3", 1), (6, 1, 3, 1, 2, "b6", 2), (7, 2, 0, 0, 3, "Nc3", 0),
    ]
    assert nodes[5]["start_comment"] == "quiet" and nodes[0]["comment"] == "wide"
    assert nodes[2]["nags"] == [6] and nodes[4]["nags"] == [2]
    assert one(spark, "{first} 1. c4", T.root_comment) == "first"
    same = one(spark, "1. d4 d5 2. c4 (2. c4 dxc4) 2... e6 *", T.tree)  # a variation that begins like the main line
    assert [n["san"] for n in same if n["variation"] == 0] == ["d4", "d5", "c4", "e6"]
    assert one(spark, "(1. f4) 1. c4", T.count_nodes) == 1
    assert one(spark, "1. c4 ((1. f4) 1. d4) c5 ) (1... e5 (2. g3", T.count_nodes) == 5
    null = spark.createDataFrame([(None,)], "t string").select(T.tree("t").alias("a"), T.count_nodes("t").alias("b"))
    assert tuple(null.first()) == (None, None)


def test_long_records(spark):
    """Trees and splitting cost what the text's length is: 20,000 nodes, and as many results."""
    text = "1. c4 " + "".join(f"(1. d4 {{n{i}}} d5) " for i in range(10_000))
    nodes = one(spark, text, T.tree)
    assert len(nodes) == 20_001 == one(spark, text, T.count_nodes)
    assert (nodes[-1]["variation"], nodes[-2]["comment"], nodes[-2]["child_ix"]) == (10_000, "n9999", 10_000)
    assert len(one(spark, "1. c4 c5 1-0\n" * 20_000, X.split_by_result)) == 20_000


def test_wrap(spark):
    words = " ".join(f"w{i}" for i in range(60)) + " " + "x" * 100 + " end"
    lines = one(spark, words, C.wrap).split("\n")
    assert " ".join(lines) == words
    assert all(len(x) <= 80 or " " not in x for x in lines)


@pytest.mark.parametrize("text,want", [
    ("2020.05.01", 20200501), ("2020.??.??", 20200000), ("2020", 20200000), (" 2020-13-05 ", 20200000), ("2020/02/32", 20200200),
    ("????.05.01", None), ("0999.01.01", None), ("3000.01.01", None), ("20", None), (None, None), ("2020.05.01 12:00", 20200501),
])
def test_dates(spark, text, want):
    assert one(spark, text, C.parse_partial_date) == want


ANNOTATED = "1. c4!? $3 {wide} e5 (1... c5 $6 2. g3 {in) line} (2. b3?)) 2. Nc3 Nf6 {note\n[%clk 0:00:07] (of 4)} 3. g3 (3. e4 Bb4 (3... d6)) d5 4. cxd5 Nxd5 1-0"
MAKERS = {
    "txt_12_tree": lambda c: T.tree(c),
    "txt_10_variations": lambda c: T._per_record(c, T._LINES, T._lines_of),
}


@pytest.mark.parametrize("name", ["txt_12_tree", "txt_10_variations"])
def test_trees_cost_less_than_counting_nodes(spark, name):
    """Units are found in one pass and distinct ones read once, so whole trees cost less than the count by columns, which
    finds its tokens in seven passes."""
    texts = spark.range(0, 12_000, 1, 4).select(F.concat(F.lit(ANNOTATED), F.lit(" ; line "), F.col("id").cast("string")).alias("t")).localCheckpoint()

    def seconds(make) -> float:
        took = []
        for _ in range(3):
            begin = time.perf_counter()
            texts.select(make("t").alias("r")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        return min(took)

    seconds(T.count_nodes)
    assert seconds(MAKERS[name]) < 0.8 * seconds(T.count_nodes)


def test_paths_of_nested_variations(spark):
    row = spark.createDataFrame([(ANNOTATED,)], "t string").select(T.tree("t").alias("nodes")).select(
        F.transform("nodes", lambda n: F.array_join(T.tree_path("nodes", n["node"]), " ")).alias("p")).first()["p"]
    assert row[:6] == ["c4", "c4 e5", "c4 c5", "c4 c5 g3", "c4 c5 b3", "c4 e5 Nc3"] and row[-1] == "c4 e5 Nc3 Nf6 g3 d5 cxd5 Nxd5"
    assert "c4 e5 Nc3 Nf6 e4 d6" in row


def test_splitting_walks_pieces_not_words(spark):
    """Words between results are one piece, so long games are split for a small multiple of what their words cost."""
    line = "1. c4 e5 2. Nc3 Nf6 {1-0 came} 3. g3 d5 $4 4. cxd5 Nxd5 " * 20
    texts = spark.range(0, 2_000, 1, 4).select(F.concat(F.lit(f"{line} 1-0 {{then}} {line} (0-1) 1/2 ; 1-0\n{line} *"), F.col("id").cast("string")).alias("t"))
    texts = texts.localCheckpoint()

    def seconds(make) -> float:
        took = []
        for _ in range(4):
            begin = time.perf_counter()
            texts.select(make("t").alias("r")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        return min(took)

    counts = texts.select(F.transform(X.split_by_result("t"), lambda g: F.size(X.mainline_tokens(g))).alias("n"), X.split_by_result("t").alias("g")).distinct()
    row = counts.orderBy("g").first()
    assert row["n"] == [160, 160, 160] and row["g"][1].endswith("(0-1) 1/2 ; 1-0")
    assert seconds(X.split_by_result) < 2.5 * seconds(X.mainline_tokens)
