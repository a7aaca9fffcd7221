"""Replaying moves: what counts as the one legal move a token names."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludograph.functions import columns as C
from ludograph.functions.columns import spread_board
from ludograph.functions.hashing import position_hash, rule_keys, to_hex
from ludograph.operators import board as B
from ludograph.operators.replay import line_state, plies, replay_games, text_state


def run(spark, moves, start=None):
    df = spark.createDataFrame([(1, moves.split(), start)], "id int, tokens array<string>, start_state string")
    games = replay_games(df)
    row = games.first()
    rows = plies(games, "id", "tokens").orderBy("ply").collect()
    return row, [r["uci"] for r in rows[:-1]], [r["epd"] for r in rows]


CASES = [
    # written moves, start, expected coordinates (stopping early where a token names no legal move)
    ("d4 Nf6 c4 g6 Nc3 Bg7 e4 O-O", None, "d2d4 g8f6 c2c4 g7g6 b1c3 f8g7 e2e4 e8g8"),
    ("c2-c4 e7e5 Nb1-c3 Nb8c6 g2g3 g7-g6 Bf1g2", None, "c2c4 e7e5 b1c3 b8c6 g2g3 g7g6 f1g2"),
    ("d4 d5 Ra3", None, "d2d4 d7d5"),  # the rook is shut in
    ("g3 d5 bg2", None, "g2g3 d7d5 f1g2"),  # no pawn can do that, so the letter is a bishop's
    ("d4 d5 g1f3", None, "d2d4 d7d5 g1f3"),
    ("d4 d5 a1a3", None, "d2d4 d7d5"),
    ("c4 c5 c5", None, "c2c4 c7c5"),  # blocked
    ("c4 d5 d5", None, "c2c4 d7d5"),  # a capture names its file
    ("c4 d5 cxd5", None, "c2c4 d7d5 c4d5"),
    ("c4 -- Nc3", None, "c2c4 0000 b1c3"),
    ("d4 e6 c4 Bb4+ --", None, "d2d4 e7e6 c2c4 f8b4"),  # no pass in check
    ("dxc8=R", "2r5/3P2k1/8/8/8/8/8/K7 w - - 0 1", "d7c8r"),
    ("d8B", "2r5/3P2k1/8/8/8/8/8/K7 w - - 0 1", "d7d8b"),
    ("d8", "2r5/3P2k1/8/8/8/8/8/K7 w - - 0 1", ""),  # into what?
    ("c8=Q", "2r5/3P2k1/8/8/8/8/8/K7 w - - 0 1", ""),
    ("d7d8n", "2r5/3P2k1/8/8/8/8/8/K7 w - - 0 1", "d7d8n"),
    ("dxc6 Kf6", "8/6k1/8/2pP4/8/8/8/6K1 w - c6 0 1", "d5c6 g7f6"),
    ("dxc6e.p.", "8/6k1/8/2pP4/8/8/8/6K1 w - c6 0 1", "d5c6"),
    ("dxc6", "8/6k1/8/2pP4/8/8/8/6K1 w - - 0 1", ""),  # too late
    ("e1c1 e8g8", "r3k2r/p6p/8/8/8/8/P6P/R3K2R w KQkq - 0 1", "e1c1 e8g8"),
    ("e1c1n", "r3k2r/p6p/8/8/8/8/P6P/R3K2R w KQkq - 0 1", ""),
    ("O-O", "4k3/8/8/8/3b4/8/8/4K2R w K - 0 1", ""),  # the bishop sees g1
    ("O-O", "4k3/8/8/8/2b5/8/8/4K2R w K - 0 1", ""),  # the bishop sees f1
    ("O-O-O", "4k3/8/8/8/4b3/8/8/R3K3 w Q - 0 1", "e1c1"),  # the bishop sees b1, which only the rook passes
    ("O-O-O", "7k/8/8/8/8/8/8/R3K3 w - - 0 1", ""),  # no right
    ("Kf1 Kg8 Ke1 Kh8 O-O-O", "7k/8/8/8/8/8/8/R3K3 w Q - 0 1", "e1f1 h8g8 f1e1 g8h8"),  # right lost
    ("Rd1", "6k1/8/8/8/8/8/4K3/R6R w - - 0 1", ""),  # two rooks
    ("Rad1", "6k1/8/8/8/8/8/4K3/R6R w - - 0 1", "a1d1"),
    ("R2d4", "7k/3R4/8/8/8/8/3R4/4K3 w - - 0 1", "d2d4"),
    ("Nd5", "4k3/8/8/8/4r3/2N1N3/8/4K3 w - - 0 1", "c3d5"),  # the other one is pinned
    ("Ne3f5", "4k3/8/8/8/4r3/2N1N3/8/4K3 w - - 0 1", ""),  # pinned
    ("e4 e5 Qh5 Nc6 Bc4 Nf6 Qxf7#", None, "e2e4 e7e5 d1h5 b8c6 f1c4 g8f6 h5f7"),
    ("y", None, ""),
]


@pytest.mark.parametrize("moves,start,want", CASES)
def test_moves(spark, moves, start, want):
    row, got, _ = run(spark, moves, start)
    assert got == want.split()
    assert (row["warning"] is None) == (len(want.split()) == len(moves.split()))


def test_positions(spark):
    _, _, texts = run(spark, "d4 c5 d5 e5 Kd2 Ke7")
    assert texts[0] == "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
    assert texts[1] == "rnbqkbnr/pppppppp/8/8/3P4/8/PPP1PPPP/RNBQKBNR b KQkq -"
    assert texts[4] == "rnbqkbnr/pp1p1ppp/8/2pPp3/8/8/PPP1PPPP/RNBQKBNR w KQkq e6"
    assert texts[6] == "rnbq1bnr/pp1pkppp/8/2pPp3/8/8/PPPKPPPP/RNBQ1BNR w - -"


def test_pinned_capture_is_keyed_but_not_printed(spark):
    # A pawn stands beside the pushed pawn, but taking would open the rank to the king.
    start = "8/8/8/8/R4p1k/8/6P1/6K1 w - - 0 1"
    _, _, texts = run(spark, "g4", start)
    assert texts[1].endswith(" b - -")
    keyed = line_state(["g4"], start)
    assert keyed == text_state("8/8/8/8/R4pPk/8/8/6K1 b - g3 0 1") != text_state("8/8/8/8/R4pPk/8/8/6K1 b - - 0 1")


@pytest.mark.parametrize("text", [
    "8/8/3q4/8/8/3Q4/8/8 w - - 0 1", "k7/8/8/8/8/8/8/R6K w - - 0 1", "k7/8/8/8/8/8/7K w - -", "k7/8/8/8/8/8/8/7K z - -",
    "k7/8/8/8/8/8/8/P6K w - -", "k7/8/8/8/8/8/8/7K w T -", "k7/8/9/8/8/8/8/7K w - -",
])
def test_bad_starts(spark, text):
    row, got, _ = run(spark, "e4", text)
    assert row["error"].startswith("invalid start position") and got == []


def test_start_text(spark):
    row, _, _ = run(spark, "e4", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w HAha - 0 1")
    assert row["start_text"] is None
    row, _, _ = run(spark, "Kg1", "k7/8/8/8/8/8/8/7K w KQkq d6")
    assert row["start_text"] == "k7/8/8/8/8/8/8/7K w - - 0 1"


def test_keys_follow_positions_not_paths():
    assert line_state("d4 d5 c4 e6".split()) == line_state("c4 e6 d4 d5".split())
    assert line_state("Nf3 Nf6 Ng1 Ng8".split()) == line_state([])
    assert line_state(["e4"]) != line_state(["e3"])
    other = tuple(range(1, 782))
    assert line_state([], None, other) != line_state([])


def test_text_hash_equals_replay_hash(spark):
    texts = [B.START, "8/6k1/8/2pP4/8/8/8/6K1 w - c6 0 1", "r3k2r/8/8/8/2Pp4/8/8/R3K2R b KQkq c3 0 1", "8/5k2/8/R7/8/8/8/K7 b - - 5 9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", position_hash("t").alias("h"), to_hex(position_hash("t")).alias("x")).collect():
        assert row["h"] == text_state(row["t"])
        assert int(row["x"], 16) == row["h"] % (1 << 64)


def test_incremental_key_equals_full_key():
    """After every ply the running key equals one worked out from the board."""
    line = "d4 Nf6 c4 e6 Nc3 Bb4 e3 O-O Bd3 d5 Nf3 c5 O-O Nc6 a3 Bxc3 bxc3 dxc4 Bxc4 Qc7".split()
    keys = B.keys_for()
    table = np.array([[*B.read_token(t)[:6], -1] for t in line])
    batch = B.Batch([B.read_position(B.START)], keys)
    rows = np.array([0])
    for code in table:
        src, dst, promo = batch.find(rows, code[None, :])
        assert src[0] >= 0
        batch.play(rows, src, dst, promo)
        full = np.bitwise_xor.reduce(keys.piece[batch.board[:, :64], np.arange(64)], axis=1)
        assert full[0] == batch.placed[0]


def test_batches_do_not_change_results(spark):
    lines = ["c4 e5 Nc3 Nf6", "d4 f5 g3", "e4 e5 Qh5 Nc6 Bc4 Nf6 Qxf7#", "d4 d5 Ra3", ""] * 40
    df = spark.createDataFrame([(i, m.split(), None) for i, m in enumerate(lines)], "id int, tokens array<string>, start_state string")
    want = None
    for n in (1, 7, 64):
        got = sorted((r["id"], tuple(r["moves"]), tuple(r["hashes"])) for r in replay_games(df.repartition(n), texts=False).collect())
        assert want in (None, got)
        want = got


def test_move_keys(spark):
    df = spark.createDataFrame([("e2e4",), ("e7e8q",), ("0000",), ("h8a1",)], "u string")
    rows = df.select("u", C.uci_to_move("u").alias("m")).select("u", "m", C.move_to_uci("m").alias("b")).collect()
    assert all(r["u"] == r["b"] for r in rows)
    assert rows[0]["m"] == 12 | 28 << 6 and rows[1]["m"] == 52 | 60 << 6 | 5 << 12
    assert df.select(F.max(C.uci_to_move(F.lit("e9e4")))).first()[0] is None


def test_text_hash_costs_a_few_replaces(spark):
    """The pieces of all texts of a batch are read at once, so a key costs a few times what spelling out its squares does."""
    text = "rnb1kb1r/pp2pppp/2p2n2/q7/2BP4/2N2N2/PPP2PPP/R1BQK2R b KQkq - "
    df = spark.range(0, 120_000, 1, 4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).localCheckpoint()

    def seconds(make) -> float:
        took = []
        for _ in range(4):
            begin = time.perf_counter()
            df.select(make("t").alias("r")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        return min(took)

    assert seconds(position_hash) < 7 * seconds(spread_board)


def test_text_hash_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "K"), (4, "8/8/8/8/8/8/8/8 w"), (5, "é7/8/8/8/8/8/8/7K9k - -")], "i int, t string")
    got = {r["i"]: r["h"] for r in df.coalesce(1).select("i", position_hash("t").alias("h")).collect()}
    keys = rule_keys()
    at = lambda p, s: keys["pPnNbBrRqQkK".index(p) * 64 + (7 - s // 8) * 8 + s % 8]
    rest = 0
    for s in range(64):
        rest ^= at("p", s)
    assert got == {1: 0, 2: rest, 3: rest ^ at("p", 0) ^ at("K", 0), 4: keys[780], 5: at("K", 63)}
