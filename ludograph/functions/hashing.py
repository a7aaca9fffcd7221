"""64-bit state keys: exclusive-or of one key per feature.

A position's features are its (piece, square) pairs, castling rights, the en-passant file (only when
a pawn of the side to move stands beside the pushed pawn) and White to move. The 781 feature keys
are a parameter: by default they follow a rule (``rule_keys``); pass the published table of opening
book keys (``read_keys``) to join books made elsewhere. Its order is the usual one: 12 x 64 piece
keys (black pawn, white pawn, black knight, ... from a1), 4 castling rights, 8 files, 1 side.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ludograph.functions.columns import col, let, spread_board
from ludograph.session import ship

N_KEYS = 781
PIECE_ORDER = "pPnNbBrRqQkK"  # fixed value: order of the piece keys


def signed64(n: int) -> int:
    n &= 0xFFFFFFFFFFFFFFFF
    return n - (1 << 64) if n >> 63 else n


@lru_cache(maxsize=1)
def rule_keys() -> tuple[int, ...]:
    """Key i = the first 8 bytes of md5("state-key-i"), as a signed number."""
    return tuple(
        signed64(int(hashlib.md5(f"state-key-{i}".encode()).hexdigest()[:16], 16)) for i in range(N_KEYS)
    )


def read_keys(spark: SparkSession, path: str) -> tuple[int, ...]:
    """Key table from text: one 16-digit hexadecimal key per line, 781 lines in order."""
    rows = spark.read.schema("value string").text(path).limit(N_KEYS + 1).collect()
    keys = tuple(signed64(int(r[0].strip().removeprefix("0x"), 16)) for r in rows if r[0].strip())
    if len(keys) != N_KEYS:
        raise ValueError(f"expected {N_KEYS} keys, found {len(keys)}")
    return keys


def to_hex(c: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(col(c))), 16, "0")


def from_hex(c: Column | str) -> Column:
    return F.conv(col(c), 16, -10).cast("bigint")


def piece_keys(texts: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Exclusive-or of the (piece, square) keys of position texts, over the bytes of all texts at once. A square that a text
    does not tell counts as a black pawn; NULL has no squares."""
    n, known = len(texts), np.zeros(len(texts), np.int64)
    if not n:
        return known
    given = texts.is_valid().to_numpy(zero_copy_only=False)
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    code = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    begin, size = ends[:-1] - ends[0], np.diff(ends)
    blanks = np.concatenate([[0], np.cumsum(code == 32)])
    placed = blanks[1:] == np.repeat(blanks[begin], size)  # before the first blank
    steps = np.concatenate([[0], np.cumsum(np.where(placed, _WIDTHS[code], 0))])
    square = steps[:-1] - np.repeat(steps[begin], size)
    kind = np.where(placed & (square < 64), _KINDS[code], -1)
    # Reading order starts at a8, keys at a1.
    at = np.flatnonzero(kind >= 0)
    found = keys[kind[at] * 64 + (7 - square[at] // 8) * 8 + square[at] % 8]
    row = np.repeat(np.arange(n), size)[at]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    if len(row):
        known[row[first]] = np.bitwise_xor.reduceat(found, first)
    told = steps[begin + size] - steps[begin]
    for i in np.flatnonzero((told < 64) & given):
        for s in range(int(told[i]), 64):
            known[i] ^= keys[(7 - s // 8) * 8 + s % 8]
    return known


_KINDS = np.full(256, -1)
_KINDS[[ord(p) for p in PIECE_ORDER]] = range(12)
_WIDTHS = np.ones(256, np.int64)
_WIDTHS[0x80:0xC0] = 0  # later bytes of a character
_WIDTHS[[ord(x) for x in "/12345678"]] = range(9)


def position_hash(c: Column | str, keys: tuple[int, ...] | None = None) -> Column:
    """State key of a position text, row by row (no shuffle). The pieces are one pass of an Arrow function over the bytes of
    a batch; the other features are columns."""
    ship(SparkSession.active())
    keys = keys or rule_keys()
    files = F.array(*[F.lit(k) for k in keys[772:780]])
    zero = F.lit(0).cast("bigint")
    held = np.array(keys[:768], np.int64)

    @F.arrow_udf("bigint")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array(piece_keys(texts, held), pa.int64())

    def total(p: Column) -> Column:
        turn, rights, ep, out = p["turn"], p["rights"], p["ep"], p["pieces"]
        for n, letter in enumerate("KQkq"):
            out = out.bitwiseXOR(F.when(rights.contains(letter), F.lit(keys[768 + n])).otherwise(zero))
        file = F.instr(F.lit("abcdefgh"), F.substring(ep, 1, 1))
        # The pushed pawn stands on rank 5 for White to move, on rank 4 otherwise.
        before = F.when(turn == "w", 24).otherwise(32)
        pawn = F.when(turn == "w", "P").otherwise("p")
        beside = lambda board: (
            ((file > 1) & (F.substring(board, before + file - 1, F.lit(1)) == pawn))
            | ((file < 8) & (F.substring(board, before + file + 1, F.lit(1)) == pawn))
        )
        capturable = (ep != "-") & (file > 0) & let(spread_board(p["text"]), beside)
        out = out.bitwiseXOR(F.when(capturable, F.element_at(files, file)).otherwise(zero))
        return out.bitwiseXOR(F.when(turn == "w", F.lit(keys[780])).otherwise(zero))

    parts = F.split(col(c), r"\s+")
    return let(
        F.struct(
            col(c).alias("text"), pieces(col(c)).alias("pieces"), F.get(parts, F.lit(1)).alias("turn"),
            F.get(parts, F.lit(2)).alias("rights"), F.get(parts, F.lit(3)).alias("ep"),
        ),
        total,
    )


def text_key(c: Column, digits: int = 15) -> Column:
    """Non-negative integer from the first hexadecimal digits of a text's md5 (portable to other SQL)."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("bigint")
