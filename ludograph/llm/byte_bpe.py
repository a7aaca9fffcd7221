"""Byte-level BPE with DuckDB recursive queries in each partition.

Encoding: texts are cut at blanks in Arrow, and the distinct pieces of a batch by the vocabulary's pattern into words. The
distinct words become rows of token and position. A recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of least rank, until no pair is left. A row carries its neighbours' ids and ranks, so one step needs no
sorting. Words met lately are remembered (a bounded number). Pieces string their words' ids together, and texts those of their
pieces, as Arrow lists.

Decoding: the ids of a batch, in the order of documents and positions, look up their tokens' bytes in an Arrow array, which
lays them one after another; documents are cut from it.

The merge table holds each pair of tokens whose joined bytes are a token, with that token's rank: the least rank
merges first, as in the rank file's own library. The vocabulary is broadcast (its size is checked). A word of n bytes
takes at most n steps of n rows. Words from ``LONG_WORD`` bytes on contract all pairs of their least rank in a step, from the
left and without overlap, so that they take a step for each rank that occurs. That is the same as one after another, unless a
new pair ranks before the one contracted; then the step takes the leftmost pair only.

Null and empty texts have no ids and decode to empty bytes. An id outside the vocabulary, or null, raises an error.
Columns named like a new one are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ludograph.llm.common import Recent, give_back, prepare, slices, without_collection

CACHED_BYTES = 64 << 20  # of each of two generations of words, in a worker
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20  # of texts that are cut into distinct pieces together
LONG_WORD = 400
CHUNK_BYTES = 200_000  # of distinct words in one recursive query
MAX_VOCABULARY = 32 << 20
WIDE_RANK = (1 << 22) - 1  # vocabularies with such ranks take the query of long words for all words

# w word, p position, t token; n, nt: position and token of the next row; pt: token of the row before;
# k: rank of the pair with the next row; pk: the pair with the row before can merge; c: pairs of the word that can merge.
# A step takes the least (k, p) of each word: row p gets token k, row n goes, and the rows beside them learn of it. A word is
# done when c is 0. What a step must know of a pair is one number, so that the least of them is found fast: 22 bits of k,
# 9 of p, 9 of n, 22 of pt, 1 of pk.
ENCODE = """
with recursive s as (
  select w, p, t, n, nt, k, pt, pk, c from start
  union all
  select s.w, s.p,
    case when s.p = h.p then h.k else s.t end as t,
    case when s.p = h.p then h.n2 else s.n end as n,
    case when s.p = h.p then h.t2 when s.n = h.p then h.k else s.nt end as nt,
    case when s.p = h.p then h.right_k when s.n = h.p then h.left_k else s.k end as k,
    case when s.p = h.n2 then h.k else s.pt end as pt,
    case when s.p = h.p then h.left_k is not null when s.p = h.n2 then h.right_k is not null else s.pk end as pk,
    (s.c - 1 - h.pk - (h.k2 is not null)::int
       + (h.left_k is not null)::int + (h.right_k is not null)::int)::int as c
  from s join (
    select b.w, b.p, b.n, b.k, b.pk, d.n as n2, d.nt as t2, d.k as k2, mr.k as right_k, ml.k as left_k
    from (
      select w, (a >> 41)::int as k, ((a >> 32) & 511)::int as p, ((a >> 23) & 511)::int as n,
             nullif(((a >> 1) & 4194303)::int, 4194303) as pt, (a & 1)::int as pk
      from (
        select w, min((k::bigint << 41) | (p::bigint << 32) | (n::bigint << 23) | (coalesce(pt, 4194303)::bigint << 1)
                      | pk::bigint) as a
        from s where k is not null group by w
      )
    ) b
    join s d on d.w = b.w and d.p = b.n
    left join merges mr on mr.pair = (b.k::bigint << 32) | d.nt
    left join merges ml on ml.pair = (b.pt::bigint << 32) | b.k
  ) h on s.w = h.w
  where s.p <> h.n
)
select w, list(t order by p) as ids from s where c = 0 group by w
"""

LONG_START = """
create or replace temp table start_long as
select w, p, t, m.k, (count(m.k) over (partition by w))::int as c
from (select w, p, t, lead(t) over (partition by w order by p) as nt from given) left join merges m on m.pair = (t::bigint << 32) | nt
"""

# k rank of the pair with the next row, r the least of the word. Of hits in a row every second one is free of overlap.
# early: a pair with the new token would rank before it.
LONG_ENCODE = """
with recursive s as (
  select w, p, t, k, c from start_long
  union all
  select w, p, t, k, (count(k) over (partition by w))::int as c from (
    select w, p, t, m.k from (
      select w, p, t, lead(t) over (partition by w order by p) as nt from (
        select w, p, case when taken then r else t end as t, coalesce(lag(taken) over (partition by w order by p), false) as gone
        from (
          select w, p, t, r, free and (p = first or not bool_or(free and early) over (partition by w)) as taken from (
            select h.w, h.p, h.t, h.r, h.hit and row_number() over (partition by h.w, h.island, h.hit order by h.p) % 2 = 1 as free,
              min(case when h.hit then h.p end) over (partition by h.w) as first,
              h.hit and least(ml.k, mr.k, mm.k) < h.r as early
            from (
              select *, sum((not hit)::int) over (partition by w order by p) as island from (
                select *, coalesce(k = r, false) as hit from (
                  select w, p, t, k, min(k) over (partition by w) as r, lag(t) over o as pt, lead(t, 2) over o as t2
                  from s where c > 0 window o as (partition by w order by p)
                )
              )
            ) h
            left join merges ml on h.hit and ml.pair = (h.pt::bigint << 32) | h.r
            left join merges mr on h.hit and mr.pair = (h.r::bigint << 32) | h.t2
            left join merges mm on h.hit and mm.pair = (h.r::bigint << 32) | h.r
          )
        )
      ) where not gone
    ) left join merges m on m.pair = (t::bigint << 32) | nt
  )
)
select w, list(t order by p) as ids from s where c = 0 group by w
"""

_coders: dict[bytes, ByteBpe] = {}


def _bytes_of(key: str, ids: bytes) -> int:
    return 250 + len(key) + len(ids)


class ByteBpe:
    """One vocabulary in a DuckDB of this process."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = ranks
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.held: set[str] = set()
        self.cut = regex.compile(pattern)
        self.space = regex.compile(r"\s")
        self.words = Recent(self._encode_words, CACHED_BYTES, _bytes_of)

    def _need(self, name: str) -> None:
        """Load the merge table or the vocabulary when it is first used: a worker mostly encodes or decodes only."""
        if name in self.held:
            return
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
        if name == "merges":
            pairs = array("q")
            for t, rank in tokens.items():
                for i in range(1, len(t)):
                    if t[:i] in tokens and t[i:] in tokens:
                        pairs.extend((tokens[t[:i]], tokens[t[i:]], rank))
            left, right, rank = np.frombuffer(pairs, dtype=np.int64).reshape(-1, 3).T
            self._load(name, pa.table({"pair": left << 32 | right, "k": rank.astype(np.int32)}))
            self.bytes = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int32)
            self.pairs = np.full(1 << 16, -1, dtype=np.int32)  # ranks of two bytes, -1: none
            for t, rank in tokens.items():
                if len(t) == 2:
                    self.pairs[t[0] << 8 | t[1]] = rank
            self.wide = max(tokens.values()) >= WIDE_RANK
        else:
            by_id = sorted((rank, t) for t, rank in tokens.items())
            self.ids = np.array([rank for rank, _ in by_id])
            self.gaps = bool((self.ids != np.arange(len(by_id))).any())
            self.tokens = pa.array([t for _, t in by_id], pa.large_binary())
        self.held.add(name)
        give_back()

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("loaded", table)
        self.db.execute(f"create table {name} as select * from loaded")
        self.db.unregister("loaded")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw])
        out: list[bytes] = [b""] * len(raw)
        for places, long in ((np.flatnonzero(sizes < LONG_WORD), False), (np.flatnonzero(sizes >= LONG_WORD), True)):
            chunk = np.cumsum(sizes[places]) // CHUNK_BYTES
            for c in np.unique(chunk):
                part = places[chunk == c]
                for i, ids in zip(part.tolist(), self._merge([raw[i] for i in part.tolist()], sizes[part], long)):
                    out[i] = ids
        return out

    def _merge(self, raw: list[bytes], sizes: np.ndarray, long: bool = False) -> list[bytes]:
        self._need("merges")
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        place = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        if long or self.wide:
            self.db.register("given", pa.table({"w": owner, "p": place, "t": self.bytes[data]}))
            self.db.execute(LONG_START)
            found = self.db.sql(LONG_ENCODE).to_arrow_table()
            self.db.unregister("given")
        else:
            self.db.register("start", self._start(data, owner, place, sizes))
            found = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("start")
        ids = found["ids"].combine_chunks()
        flat = ids.flatten().to_numpy().tobytes()
        ends = 4 * np.cumsum(ids.value_lengths().to_numpy())
        out = [b""] * len(raw)
        for w, a, b in zip(found["w"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out[w] = flat[a:b]
        return out

    def _start(self, data: np.ndarray, owner: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> pa.Table:
        """The rows of words before any step: one a byte."""
        token = self.bytes[data]
        first, last = place == 0, np.zeros(len(data), bool)
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        rank = np.where(last, -1, self.pairs[data.astype(np.int32) << 8 | np.roll(data, -1)]).astype(np.int32)
        pairs = np.bincount(owner[rank >= 0], minlength=len(sizes)).astype(np.int32)

        def shifted(values: np.ndarray, by: int, none: np.ndarray) -> pa.Array:
            return pa.array(np.roll(values, by), mask=none)

        return pa.table({
            "w": owner, "p": place, "t": token, "n": place + np.int32(1), "nt": shifted(token, -1, last),
            "k": pa.array(rank, mask=rank < 0), "pt": shifted(token, 1, first),
            "pk": ~first & (np.roll(rank, 1) >= 0), "c": pairs[owner],
        })

    def _cut(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """The words of pieces without a blank, each with a blank before it, one piece's after another's, and their numbers."""
        if not len(pieces):
            return [], np.zeros(0, np.int64)
        joined = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py()
        words = self.cut.findall(joined)
        begins = np.flatnonzero(np.array([w.startswith(" ") for w in words], bool))
        if len(begins) == len(pieces):  # every blank begins a word, so no word lies in two pieces
            return words, np.diff(begins, append=len(words))
        cut = [self.cut.findall(" " + p) for p in joined[1:].split(" ")]
        return [w for c in cut for w in c], np.array(list(map(len, cut)), dtype=np.int64)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text's after another's, and their numbers. A blank before a visible character always begins
        a word, so texts are cut there, which is cheap, and only distinct pieces meet the pattern. Texts with a blank
        elsewhere meet it whole."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.string())
        parts = pc.split_pattern(texts, " ")
        pieces, counts = parts.flatten().dictionary_encode(), parts.value_lengths().to_numpy()
        names, at = pieces.dictionary, pieces.indices.to_numpy()
        heads = np.cumsum(counts) - counts  # what is before a text's first blank
        behind = np.ones(len(at), bool)
        behind[heads] = False
        first = pc.utf8_slice_codeunits(names, 0, 1)
        late = [c for c in first.unique().to_pylist() if not c or self.space.match(c)]
        odd = pc.is_in(first, pa.array(late, pa.string())).to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduceat(odd[at] & behind, heads)
        behind &= ~np.repeat(whole, counts)

        used = np.flatnonzero(np.bincount(at[behind], minlength=len(names)))
        words, held = self._cut(names.take(pa.array(used)))
        own = pc.if_else(pa.array(whole), texts, names.take(pa.array(at[heads]))).to_pylist()
        own = [self.cut.findall(t) for t in own]
        words += [w for c in own for w in c]
        held = np.append(held, list(map(len, own)))
        known = self.words.table(set(words))
        coded = [known[w] for w in words]
        ends = np.append(0, np.cumsum(list(map(len, coded)), dtype=np.int64) // 4)[np.append(0, np.cumsum(held))]
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))

        row = np.zeros(len(names), np.int64)
        row[used] = np.arange(len(used))
        row = row[at]
        row[heads] = len(used) + np.arange(len(heads))
        behind[heads] = True
        sizes = np.add.reduceat(np.where(behind, np.diff(ends)[row], 0), heads)
        return lists.take(pa.array(row[behind])).flatten().to_numpy(), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        flat, sizes = self.encode_column(pa.array(texts, pa.string()))
        return [flat[b - n : b] for b, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of id lists that lie one after another."""
        self._need("vocabulary")
        rows = np.searchsorted(self.ids, flat) if self.gaps else flat
        if len(flat) and not (0 <= rows.min() and rows.max() < len(self.ids) and (not self.gaps or (self.ids[rows] == flat).all())):
            raise ValueError("an id is not in the vocabulary")
        found = self.tokens.take(pa.array(rows))
        _, offsets, data = found.buffers()
        if not data:
            return [b""] * len(sizes)
        ends = np.frombuffer(offsets, np.int64)[np.append(0, np.cumsum(sizes))].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(ends[:-1], ends[1:])]


def coder(ranks: bytes, pattern: str) -> ByteBpe:
    """The coder of this worker process for a vocabulary; one is held at a time."""
    key = hashlib.sha256(ranks + b"\0" + pattern.encode()).digest()
    if key not in _coders:
        _coders.clear()
        give_back()
        _coders[key] = ByteBpe(ranks, pattern)
    return _coders[key]


def _shared(df: DataFrame, ranks: bytes, pattern: str):
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(ranks)} bytes is too large to broadcast")
    return prepare(df.sparkSession).sparkContext.broadcast((ranks, pattern))


def _extended(df: DataFrame, added: dict[str, T.DataType], column: str, make, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns that ``make`` works out from an Arrow array of another, without those ``dropped``."""
    if column in added:
        raise ValueError("the new column must have a name of its own")
    rest = df.drop(*added)
    at = rest.columns.index(column)
    kept = [i for i, c in enumerate(rest.columns) if c not in dropped]
    schema = T.StructType([*[rest.schema.fields[i] for i in kept], *[T.StructField(n, t) for n, t in added.items()]])

    def extend(batches):
        with without_collection():
            for batch in slices(batches, BATCH_ROWS, BATCH_BYTES):
                columns = [*[batch.column(i) for i in kept], *make(batch.column(at))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(extend, schema)


def _encoded(tool: ByteBpe, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    flat, sizes = tool.encode_column(column)
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), flat, sizes


def encode_texts(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the list of token ids. ``ranks`` is the rank file's content: base64 of the token, blank, rank."""
    shared = _shared(df, ranks, pattern)
    return _extended(df, {ids: T.ArrayType(T.IntegerType())}, text, lambda column: _encoded(coder(*shared.value), column)[:1])


def decode_ids(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null lists give empty bytes."""
    shared = _shared(df, ranks, pattern)

    def make(column: pa.Array) -> list[pa.Array]:
        sizes = column.value_lengths().fill_null(0).to_numpy()
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("a null id")
        return [pa.array(coder(*shared.value).decode(flat.to_numpy(), sizes), pa.binary())]

    return _extended(df, {out: T.BinaryType()}, ids, make)


def encode_and_decode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` of its ids in one pass, so a worker holds one set of tables; ``text`` goes."""
    shared = _shared(df, ranks, pattern)

    def make(column: pa.Array) -> list[pa.Array]:
        tool = coder(*shared.value)
        lists, flat, sizes = _encoded(tool, column)
        return [lists, pa.array(tool.decode(flat, sizes), pa.binary())]

    return _extended(df, {ids: T.ArrayType(T.IntegerType()), out: T.BinaryType()}, text, make, (text,))
