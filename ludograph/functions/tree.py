"""Move trees: variations as nodes, worked out inside the record's own row.

Units of text are found by columns; one pass of an Arrow function over them makes the nodes as columns, so a record of any
length costs what its length is. The number of nodes needs columns only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.functions.text import (
    _END, _MOVE_WORD, _SYMBOL, ESCAPE_LINE, GLYPHS, SYMBOLS, trimmed,
)
from ludograph.session import ship

# One pass per group gives aligned arrays: brace comment, line comment, parenthesis, $n, move, its
# glyphs, any other word.
_UNIT = (
    rf"{ESCAPE_LINE}|\{{([^}}]*+)(?:\}}|\z)|;([^\n]*+)|([()])|\$(\d*+)"
    rf"|{_MOVE_WORD}([!?]*+){_END}|({_SYMBOL})"
)

_NODES = "array<struct<node:int,parent:int,depth:int,variation:int,ply:int,san:string,nags:array<int>,comment:string,start_comment:string,child_ix:int>>"
_LINES = "array<struct<variation:int,depth:int,first_ply:int,tokens:array<string>>>"
RECORDS = 500  # whose units are Python objects at a time


def _tokens(c: Column) -> Column:
    """Typed tokens: kind c(omment), m(ove), n(ag), ( and ); moves carry the code of their glyphs."""
    names = ["brace", "line", "paren", "code", "move", "glyph", "word"]
    groups = [F.regexp_extract_all(c, F.lit(_UNIT), F.lit(n + 1)).alias(name) for n, name in enumerate(names)]
    glyphs = F.create_map(*[F.lit(x) for kv in GLYPHS.items() for x in kv])
    words = F.create_map(*[F.lit(x) for kv in {**GLYPHS, **SYMBOLS}.items() for x in kv])

    def typed(t: Column) -> Column:
        note = trimmed(F.concat(t["brace"], t["line"]))
        nag = (
            F.when(t["code"] != "", t["code"].try_cast("int"))
            .when(t["glyph"] != "", F.element_at(glyphs, t["glyph"]))
            .when(t["word"] != "", F.element_at(words, F.regexp_replace(t["word"], r"^\d+\.*|^\.+", "")))
        )
        kind = (
            F.when(t["move"] != "", "m").when(t["paren"] != "", t["paren"])
            .when((t["code"] != "") | (t["word"] != ""), "n").when(note != "", "c")
        )
        text = F.when(t["move"] == "0000", "--").when(t["move"] != "", t["move"]).otherwise(note)
        return F.struct(kind.alias("kind"), text.alias("text"), nag.alias("nag"))

    kept = lambda t: (t["kind"] != "n") | t["nag"].isNotNull()
    return F.filter(F.transform(F.arrays_zip(*groups), typed), kept)


# The same units as whole matches, for ``_read``, which tells them apart.
_WHOLE = rf"{ESCAPE_LINE}|\{{[^}}]*+\}}?+|;[^\n]*+|[()]|\$\d*+|{_SYMBOL}"
# A word runs to the next break, so to match all of it is to match up to a break.
_MOVE_HERE = re.compile(rf"{_MOVE_WORD}([!?]*+)", re.ASCII)
_BEFORE = re.compile(r"^\d+\.*|^\.+", re.ASCII)
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
_SKIP, _OPEN, _CLOSE, _MOVE, _NAG, _NOTE = range(6)


def _read(unit: str) -> tuple[int, str | None, int | None]:
    """Kind, text and code of one unit."""
    first = unit[0]
    if first in "()":
        return (_OPEN if first == "(" else _CLOSE), None, None
    if first in "{;":
        note = (unit[1:].removesuffix("}") if first == "{" else unit[1:]).strip(_BLANKS)
        return (_NOTE if note else _SKIP), note, None
    if first == "$":
        nag = int(unit[1:]) if 1 < len(unit) < 4000 else None
        return (_SKIP if nag is None or nag >= 1 << 31 else _NAG), None, nag
    if found := _MOVE_HERE.fullmatch(unit):
        move, glyph = found.groups()
        return _MOVE, "--" if move == "0000" else move, GLYPHS.get(glyph)
    word = _BEFORE.sub("", unit)
    nag = GLYPHS.get(word, SYMBOLS.get(word))
    return (_SKIP if nag is None else _NAG), None, nag


class Walk:
    """The nodes of some movetexts as columns, one list for each; ``sizes`` are the numbers of nodes, ``roots`` the comments
    of the starts."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.roots: list[str | None] = []
        self.columns: dict[str, list] = {k: [] for k in (
            "node", "parent", "depth", "variation", "ply", "san", "nags", "comment", "start_comment", "child_ix")}

    def add(self, units: list[tuple[int, str | None, int | None]]) -> None:
        """One more movetext: its nodes in reading order. A variation before any move replaces nothing and is passed over;
        a comment at the head of a variation waits for its first move."""
        parents, depths, variations, plies, sans, starts, child = [], [], [], [], [], [], []
        nags: list[list[int]] = []
        notes: dict[int, list[str]] = {}
        children = [0]
        stack: list[tuple[int, int, int, int]] = []
        cur = ply = variation = opened = skip = 0
        fresh, pending = False, []
        for kind, text, nag in units:
            if kind == _MOVE:
                if skip:
                    continue
                ply += 1
                parents.append(cur)
                depths.append(len(stack))
                variations.append(variation)
                plies.append(ply)
                sans.append(text)
                nags.append([] if nag is None else [nag])
                starts.append(" ".join(pending) if pending else None)
                child.append(children[cur])
                children[cur] += 1
                children.append(0)
                cur = len(parents)
                fresh, pending = False, []
            elif kind == _OPEN:
                stack.append((cur, ply, variation, skip))
                pending = []
                if skip or not cur:
                    skip += 1
                else:
                    opened += 1
                    cur, ply, variation, fresh = parents[cur - 1], ply - 1, opened, True
            elif kind == _CLOSE:
                if stack:
                    cur, ply, variation, skip = stack.pop()
                    fresh, pending = False, []
            elif skip:
                continue
            elif kind == _NOTE:
                (pending if fresh else notes.setdefault(cur, [])).append(text)
            elif kind == _NAG and cur and nag not in nags[cur - 1]:
                nags[cur - 1].append(nag)
        n = len(parents)
        told: list[str | None] = [None] * (n + 1)
        for node, own in notes.items():
            told[node] = " ".join(own)
        self.sizes.append(n)
        self.roots.append(told[0])
        for name, values in (("node", range(1, n + 1)), ("parent", parents), ("depth", depths), ("variation", variations), ("ply", plies),
                             ("san", sans), ("nags", nags), ("comment", told[1:]), ("start_comment", starts), ("child_ix", child)):
            self.columns[name].extend(values)


def _struct_lists(kind: pa.DataType, sizes: list[int], columns: dict[str, list], gone: pa.Array) -> pa.Array:
    """Columns of the values of all lists -> lists of structs, NULL where ``gone``."""
    inner = kind.value_type
    fields = [inner.field(n) for n in range(inner.num_fields)]
    values = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in fields], fields=fields)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, type=kind, mask=gone)


def _nodes_of(walked: Walk, kind: pa.DataType, gone: pa.Array) -> pa.Array:
    return _struct_lists(kind, walked.sizes, walked.columns, gone)


def _roots_of(walked: Walk, kind: pa.DataType, gone: pa.Array) -> pa.Array:
    return pa.array(walked.roots, kind)


def _lines_of(walked: Walk, kind: pa.DataType, gone: pa.Array) -> pa.Array:
    sizes, at = [], 0
    lines: dict[str, list] = {k: [] for k in ("variation", "depth", "first_ply", "tokens")}
    of, depth, ply, san = (walked.columns[k] for k in ("variation", "depth", "ply", "san"))
    for n in walked.sizes:
        own: dict[int, list[str]] = {}
        for i in range(at, at + n):
            v = of[i]
            if v:
                if v not in own:
                    own[v] = []
                    lines["variation"].append(v)
                    lines["depth"].append(depth[i])
                    lines["first_ply"].append(ply[i])
                    lines["tokens"].append(own[v])
                own[v].append(san[i])
        sizes.append(len(own))
        at += n
    return _struct_lists(kind, sizes, lines, gone)


def _per_record(c: Column | str, kind: str, make: Callable[[Walk, pa.DataType, pa.Array], pa.Array]) -> Column:
    """``make`` of the nodes of each movetext; NULL stays NULL. Distinct units are read once for some records."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ship(SparkSession.active())
    arrow = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def made(units: pa.Array) -> pa.Array:
        parts = [pa.array([], arrow)]
        for at in range(0, len(units), RECORDS):
            some = units.slice(at, RECORDS)
            coded = some.flatten().dictionary_encode()
            known = [_read(u) for u in coded.dictionary.to_pylist()]
            read = [known[i] for i in coded.indices.to_pylist()]
            walked, end = Walk(), 0
            for n in some.value_lengths().fill_null(0).to_pylist():
                walked.add(read[end:end + n])
                end += n
            parts.append(make(walked, arrow, some.is_null()))
        return pa.concat_arrays(parts)

    text = F.col(c) if isinstance(c, str) else c
    return made(F.regexp_extract_all(text, F.lit(_WHOLE), F.lit(0)))


def tree(c: Column | str) -> Column:
    """Movetext -> array of nodes in reading order.

    node, parent (0 = start), depth, variation (0 = main line, numbered as they open), ply (distance
    from the start), san, nags, comment, start_comment, child_ix (0 = main continuation). A move
    repeated in a variation is a node of its own. Root comments belong to node 0 (``root_comment``).
    """
    return _per_record(c, _NODES, _nodes_of)


def root_comment(c: Column | str) -> Column:
    return _per_record(c, "string", _roots_of)


def tree_nodes(df: DataFrame, key: str, movetext: str) -> DataFrame:
    """One row per node."""
    return df.select(key, F.inline(tree(movetext)))


def tree_path(nodes: Column | str, node: Column) -> Column:
    """Moves from the start to a node of the ``tree`` array."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    start = F.struct(node.cast("int").alias("cur"), F.array().cast("array<string>").alias("path"))

    def back(a: Column, _: Column) -> Column:
        n = F.get(nodes, a["cur"] - 1)
        return F.struct(
            F.when(a["cur"] > 0, n["parent"]).otherwise(0).alias("cur"),
            F.when(a["cur"] > 0, F.concat(F.array(n["san"]), a["path"])).otherwise(a["path"]).alias("path"),
        )

    length = F.coalesce(F.get(nodes, node.cast("int") - 1)["ply"], F.lit(0))
    turns = F.when(length > 0, F.sequence(F.lit(1), F.greatest(length, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, back, lambda a: a["path"])


def count_nodes(c: Column | str) -> Column:
    """The number of nodes, without making them: only the distance from the start and the open variations are kept."""
    frame = "array<struct<ply:int,skip:int>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("ply"), F.lit(0).alias("skip"), F.array().cast(frame).alias("stack"))

    def step(a: Column, t: Column) -> Column:
        idle, kind, open_ = a["skip"] > 0, t["kind"], F.size(a["stack"])
        move, opens, closes = (kind == "m") & ~idle, kind == "(", (kind == ")") & (open_ > 0)
        lost = opens & (idle | (a["ply"] == 0))
        top = F.get(a["stack"], open_ - 1)
        saved = F.array(F.struct(a["ply"].alias("ply"), a["skip"].alias("skip")))
        return F.struct(
            F.when(move, a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.when(move, a["ply"] + 1).when(opens & ~lost, a["ply"] - 1).when(closes, top["ply"]).otherwise(a["ply"]).alias("ply"),
            F.when(lost, a["skip"] + 1).when(closes, top["skip"]).otherwise(a["skip"]).alias("skip"),
            F.when(opens, F.concat(a["stack"], saved)).when(closes, F.slice(a["stack"], 1, F.greatest(open_ - 1, F.lit(0))))
            .otherwise(a["stack"]).alias("stack"),
        )

    return F.aggregate(_tokens(F.col(c) if isinstance(c, str) else c), start, step, lambda a: a["n"])


def variations(df: DataFrame, key: str, movetext: str) -> DataFrame:
    """One row per variation: number, depth, ply of its first move, its moves."""
    return df.select(key, F.inline(_per_record(movetext, _LINES, _lines_of)))
