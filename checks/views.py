"""Views over the given tables, for Spark (functions) and as SQL text (constants)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.functions import columns as C
from ludograph.session import shared_folder, spread
from ludograph.operators.sequences import first_visit, horizon, position_index, states, with_child, with_final

STEPS = ["click", "error", "purchase", "signup", "view"]
END = "END"
HORIZON = 60


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder inside the shared one."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


# ---- G: one row per order, read as a game -------------------------------------------------

_G = """
select o.o_orderkey as id, c.c_name as white, s.s_name as black, p.p_name as event, n.n_name as site,
  cast(year(o.o_orderdate) * 10000
       + case when o.o_orderkey % 10 = 0 then 0 else month(o.o_orderdate) * 100
              + case when o.o_orderkey % 5 = 0 then 0 else day(o.o_orderdate) end end as int) as date,
  case o.o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as result,
  case when floor(c.c_acctbal) between 1 and 3999 then cast(floor(c.c_acctbal) as int) end as white_elo,
  case when floor(s.s_acctbal) between 1 and 3999 then cast(floor(s.s_acctbal) as int) end as black_elo,
  concat(chr(cast(65 + p.p_size % 5 as int)), lpad(cast(p.p_size as varchar(9)), 2, '0')) as eco,
  p.p_type as opening, cast(coalesce(l.n, 0) as int) as plies,
  case when p.p_size % 2 = 0 then p.p_name end as movetext
from {orders} o
join {customer} c on c.c_custkey = o.o_custkey
join {supplier} s on s.s_suppkey = o.o_orderkey % (select count(*) from {supplier})
left join {part} p on p.p_partkey = o.o_orderkey % (select count(*) from {part})
left join {nation} n on n.n_nationkey = c.c_nationkey
left join (select l_orderkey, count(*) as n from {lineitem} group by l_orderkey) l on l.l_orderkey = o.o_orderkey
"""
_TABLES = ["orders", "customer", "supplier", "part", "nation", "lineitem"]

G = f"""g0 as ({_G.format(**{t: t for t in _TABLES})}),
g as (select *, case when white_elo is not null and black_elo is not null then least(white_elo, black_elo) end as min_elo,
  case when white_elo is null then black_elo when black_elo is null then white_elo else greatest(white_elo, black_elo) end as max_elo,
  case when white_elo is null then black_elo when black_elo is null then white_elo
       else cast(floor((white_elo + black_elo + 1) / 2.0) as int) end as elo from g0)"""


def games(spark: SparkSession, d: str) -> DataFrame:
    frames = {t: table(spark, d, t) for t in _TABLES}
    frames["orders"] = spread(frames["orders"], "o_orderkey")
    g = spark.sql(_G, **frames)
    return g.select(
        "*",
        C.min_rating("white_elo", "black_elo").alias("min_elo"),
        C.max_rating("white_elo", "black_elo").alias("max_elo"),
        C.mean_rating("white_elo", "black_elo").alias("elo"),
    )


# ---- P: user days of events, read as step sequences ---------------------------------------

_COUNTS = lambda over: ", ".join(
    f"cast(coalesce(sum(case when step = '{s}' then 1 else 0 end){over}, 0) as varchar)" for s in STEPS
)
EV = """ev as (select event_id, ts, event_type as step, value, props,
  user_id * 100000000 + cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint) as game_id,
  cast(day(ts) as int) as dom, cast(round(value * 100) as bigint) as cents from events)"""
P = f"""{EV},
steps as (select game_id, event_id, ts, step, value, cents, row_number() over w - 1 as ply,
  concat_ws('|', {_COUNTS(' over b')}) as state from ev
  window w as (partition by game_id order by ts, event_id),
         b as (partition by game_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
facts as (select game_id, count(*) as n, max(dom) as year,
  case when max(case when step = 'purchase' then 1 else 0 end) = 1 then 1
       when max(case when step = 'error' then 1 else 0 end) = 1 then 2 else 3 end as result,
  cast(floor((2.0 * sum(cents) + 100.0 * count(*)) / (200.0 * count(*))) as int) as elo,
  concat_ws('|', {_COUNTS('')}) as final from ev group by game_id),
plies as (select game_id, ply, state as hash, step as move from steps
  union all select game_id, n, final, '{END}' from facts),
p as (select hash, move, p0.game_id, ply, result, elo, year from plies p0 join facts f on f.game_id = p0.game_id
  where ply <= {HORIZON})"""


def events(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    day = F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)
    return table(spark, d, "events").select(
        "event_id", "ts", F.col("event_type").alias("step"), "value", "props",
        (F.col("user_id") * 100000000 + day).cast("bigint").alias("game_id"),
        F.dayofmonth(ts).alias("dom"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def minute() -> "F.Column":
    """Pieces in which a very long day is worked on."""
    return F.hour("ts") * 60 + F.minute("ts")


ORDER = ["ts", "event_id"]


def steps(spark: SparkSession, d: str, **kw) -> DataFrame:
    return states(events(spark, d), ["game_id"], ORDER, "step", vocabulary=STEPS, bucket=minute(), **kw)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Facts per user day (map-side reduced, so a long day is no burden)."""
    ev = events(spark, d)
    has = lambda s: F.max((F.col("step") == s).cast("int")) == 1
    n = F.count(F.lit(1))
    counts = [F.sum((F.col("step") == s).cast("bigint")).cast("string") for s in STEPS]
    return ev.groupBy("game_id").agg(
        n.alias("n"),
        F.max("dom").alias("year"),
        F.when(has("purchase"), 1).when(has("error"), 2).otherwise(3).alias("result"),
        F.floor((2.0 * F.sum("cents") + 100.0 * n) / (200.0 * n)).cast("int").alias("elo"),
        F.concat_ws("|", *counts).alias("final"),
    )


def plies(spark: SparkSession, d: str, **kw) -> DataFrame:
    """(game_id, ply, hash, move): every state of every user day with the step taken from it."""
    rows = steps(spark, d, **kw).select("game_id", "ply", F.col("state").alias("hash"), F.col("step").alias("move"))
    last = sessions(spark, d).select("game_id", F.col("n").alias("ply"), F.col("final").alias("hash"))
    return with_final(rows, ["game_id"], "move", last, END)


def positions(spark: SparkSession, d: str, child: bool = False) -> DataFrame:
    rows = plies(spark, d)
    rows = with_child(rows, ["game_id"], HORIZON) if child else horizon(rows, HORIZON)
    rows = first_visit(rows, ["game_id"])
    return position_index(rows, sessions(spark, d))


# ---- R: record texts written from orders --------------------------------------------------

# i = 0.. is the number of a move in the record of order k. No rows are gathered for a record: all of
# its parts follow from the order's own key.
_HEX = "'0123456789abcdef'"
MOVE_COUNT = "3 + k % 18"


def _parts(strpos: str) -> dict[str, str]:
    digit = f"({strpos}({_HEX}, substr(md5(cast(k as varchar(20))), cast(i as int) + 1, 1)) - 1)"
    square = lambda f, r: (
        f"substr('abcdefgh', cast(1 + ({f}) % 8 as int), 1) || cast(cast(1 + ({r}) % 8 as int) as varchar(2))"
    )
    return {
        "tok": f"(substr('NBRQK', cast(1 + {digit} % 5 as int), 1) || {square(f'{digit} + i', f'{digit} + 3 * i')})",
        "alt": f"('N' || {square('i', 'k')})",
        "alt2": f"('B' || {square('k', 'i')})",
        "deep": f"('Q' || {square('k + i', 'k + 2 * i')})",
        "note": "('note' || chr(10) || '[%clk 0:00:' || lpad(cast(cast(i as int) as varchar(3)), 2, '0') || '] (of ' || cast(k as varchar(20)) || ')')",
        "has_note": "(k % 10 <> 3 and (k + i) % 5 = 0)",
        "has_nag": "(k % 10 <> 3 and (k + i) % 7 = 0)",
        "nag": "cast(1 + (k + i) % 6 as int)",
        "has_glyph": "(k % 10 <> 3 and (k + i) % 9 = 0)",
        "has_var": "(k % 10 <> 3 and (k + i) % 4 = 0)",
        "has_deep": "(k % 10 <> 3 and (k + i) % 4 = 0 and i % 2 = 0)",
    }


SPARK_PARTS, SQL_PARTS = _parts("instr"), _parts("strpos")

_PIECE = """concat(
  case when i % 2 = 0 then concat(cast(cast(i / 2 as int) + 1 as string), '. ')
       when (k + i) % 3 = 0 then concat(cast(cast((i - 1) / 2 as int) + 1 as string), '... ') else '' end,
  {tok}, case when {has_glyph} then '!?' else '' end,
  case when {has_nag} then concat(' $', cast({nag} as string)) else '' end,
  case when {has_note} then concat(' {{', {note}, '}}') else '' end,
  case when {has_var} then concat(' (', {alt}, ' ', {alt2}, ' {{in) line}}',
       case when {has_deep} then concat(' (', {deep}, ')') else '' end, ')') else '' end)""".format(**SPARK_PARTS)

# One row per move of a record, for SQL.
R = f"""{G},
r as (select id as k, white, black, event, date, result, white_elo, {MOVE_COUNT.replace('k', 'id')} as n from g),
m as (select k, i, {', '.join(f'{v} as {n}' for n, v in SQL_PARTS.items())} from
  (select k, unnest(range(0, n)) as i from r))"""
# The movetext as SQL text: pieces in order, then the result.
PIECE_SQL = """case when i % 2 = 0 then cast(i // 2 + 1 as varchar) || '. ' when (k + i) % 3 = 0 then cast(i // 2 + 1 as varchar) || '... ' else '' end
  || tok || case when has_glyph then '!?' else '' end || case when has_nag then ' $' || cast(nag as varchar) else '' end
  || case when has_note then ' {' || note || '}' else '' end
  || case when has_var then ' (' || alt || ' ' || alt2 || ' {in) line}' || case when has_deep then ' (' || deep || ')' else '' end || ')' else '' end"""
RESULT_SQL = "case result when 1 then '1-0' when 2 then '0-1' else '1/2-1/2' end"
DATE_SQL = """concat_ws('.', cast(cast(floor(date / 10000) as int) as varchar),
  case when cast(floor(date / 100) as int) % 100 > 0 then lpad(cast(cast(floor(date / 100) as int) % 100 as varchar), 2, '0') else '??' end,
  case when date % 100 > 0 then lpad(cast(date % 100 as varchar), 2, '0') else '??' end)"""


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """(k, body): movetext with comments, codes and nested variations."""
    orders = spread(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k")
    result = "case o_orderstatus when 'F' then '1-0' when 'O' then '0-1' else '1/2-1/2' end"
    return orders.select(
        "k",
        F.expr(f"concat(array_join(transform(sequence(0, cast({MOVE_COUNT} as int) - 1), i -> {_PIECE}), ' '), ' ', {result})").alias("body"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    """(k, raw): whole records with a tag section."""
    g = games(spark, d).withColumnRenamed("id", "k")
    rows = g.join(bodies(spark, d), "k")
    tag = lambda n, v: C.tag_line(n, v)
    lines = F.concat_ws(
        "\n",
        tag("Event", F.concat(F.col("event"), F.lit(' "no. '), F.col("k").cast("string"), F.lit('" \\ x'))),
        tag("Site", F.lit("?")),
        tag("Date", C.format_partial_date("date")),
        tag("Round", F.col("k").cast("string")),
        tag("White", F.col("white")),
        tag("Black", F.col("black")),
        tag("Result", C.result_text("result")),
        tag("WhiteElo", F.coalesce("white_elo", F.lit(0)).cast("string")),
        tag("TimeControl", F.concat(F.lit("40/"), (F.col("k") % 60).cast("string"))),
    )
    return rows.select("k", F.concat(lines, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("raw"))


# ---- C: real games, cut from known opening lines -------------------------------------------

# Opening lines as written moves and as coordinates.
LINES = [
    ("e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7 Re1 b5 Bb3 d6",
     "e2e4 e7e5 g1f3 b8c6 f1b5 a7a6 b5a4 g8f6 e1g1 f8e7 f1e1 b7b5 a4b3 d7d6"),
    ("e4 c5 Nf3 d6 d4 cxd4 Nxd4 Nf6 Nc3 a6 Be2 e5 Nb3 Be7",
     "e2e4 c7c5 g1f3 d7d6 d2d4 c5d4 f3d4 g8f6 b1c3 a7a6 f1e2 e7e5 d4b3 f8e7"),
    ("d4 d5 c4 e6 Nc3 Nf6 Bg5 Be7 e3 O-O Nf3 Nbd7",
     "d2d4 d7d5 c2c4 e7e6 b1c3 g8f6 c1g5 f8e7 e2e3 e8g8 g1f3 b8d7"),
    ("c4 e6 d4 d5 Nc3 c6 e3 Nf6 Nf3 Nbd7",
     "c2c4 e7e6 d2d4 d7d5 b1c3 c7c6 e2e3 g8f6 g1f3 b8d7"),
    ("e4 e6 d4 d5 e5 c5 c3 Nc6 Nf3 Qb6",
     "e2e4 e7e6 d2d4 d7d5 e4e5 c7c5 c2c3 b8c6 g1f3 d8b6"),
    ("e4 d5 exd5 Qxd5 Nc3 Qa5 d4 Nf6 Nf3 c6 Bc4 Bf5",
     "e2e4 d7d5 e4d5 d8d5 b1c3 d5a5 d2d4 g8f6 g1f3 c7c6 f1c4 c8f5"),
    ("Nf3 Nf6 Ng1 Ng8 e4 e5",
     "g1f3 g8f6 f3g1 f6g8 e2e4 e7e5"),
    ("f3 e5 g4 Qh4#",
     "f2f3 e7e5 g2g4 d8h4"),
]
ILLEGAL = "Ka5"  # never possible in these lines
NAMED = [
    ("B00", "King's Pawn", "e4"), ("C20", "Open Game", "e4 e5"), ("C60", "Spanish", "e4 e5 Nf3 Nc6 Bb5"),
    ("B20", "Sicilian", "e4 c5"), ("B90", "Sicilian: Najdorf", "e4 c5 Nf3 d6 d4 cxd4 Nxd4 Nf6 Nc3 a6"),
    ("D06", "Queen's Gambit", "d4 d5 c4"), ("D30", "Queen's Gambit Declined", "d4 d5 c4 e6"),
    ("C00", "French", "e4 e6"), ("B01", "Scandinavian", "e4 d5"), ("A04", "Zukertort", "Nf3"),
]

_values = ", ".join(f"({i}, '{s}', '{u}')" for i, (s, u) in enumerate(LINES))
CHESS = f"""lines as (select * from (values {_values}) as t(line, sans, ucis)),
c as (select o.o_orderkey as id, l.line, string_split(l.sans, ' ') as sans, string_split(l.ucis, ' ') as ucis,
  1 + (o.o_orderkey // {len(LINES)}) % len(string_split(l.sans, ' ')) as m, o.o_orderkey % 6 = 0 as broken,
  case o.o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as result
  from orders o join lines l on l.line = o.o_orderkey % {len(LINES)})"""


def chess(spark: SparkSession, d: str) -> DataFrame:
    """(id, tokens, start_state, result): a prefix of a line per order, every sixth with an illegal end."""
    lines = F.array(*[F.array(*[F.lit(w) for w in s.split()]) for s, _ in LINES])
    k = F.col("o_orderkey")
    line = F.element_at(lines, (k % len(LINES) + 1).cast("int"))
    m = F.floor(k / len(LINES)) % F.size(line) + 1
    head = F.slice(line, F.lit(1), m.cast("int"))
    tokens = F.when(k % 6 == 0, F.concat(head, F.array(F.lit(ILLEGAL)))).otherwise(head)
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey")
    return orders.select(
        k.alias("id"), tokens.alias("tokens"), F.lit(None).cast("string").alias("start_state"),
        F.expr("case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end").alias("result"),
        (F.col("o_custkey") % 40).alias("w"),
    )


def named_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMED, "eco string, name string, moves string")


def chess_records(spark: SparkSession, d: str) -> DataFrame:
    """(k, raw): the games of ``chess`` as record texts. Some repeat: names and rounds recur."""
    games = chess(spark, d)
    games = games.withColumn("r", F.col("id") % 4)
    white = F.concat(F.lit("Player "), F.col("w").cast("string"))
    heads = C.headers(
        event=F.lit("Club"), site=F.lit(None).cast("string"), date=F.lit(20200000), round=F.col("r").cast("string"),
        white=white, black=F.concat(F.lit("Guest "), F.col("r").cast("string")), result="result",
    )
    text = C.wrap(C.movetext_of("tokens", C.result_text("result")))
    return games.select(F.col("id").alias("k"), C.format_record(heads, text).alias("raw"))


# The same games, one row per distinct record (first in order), with the opening of the played moves.
CHESS_GAMES = f"""{CHESS}, cg as (select c.*, o.o_custkey % 40 as w, c.id % 4 as r, array_to_string(ucis[1:m], ' ') as moves from c join orders o on o.o_orderkey = c.id),
kept as (select w, r, result, moves, min(id) as id, any_value(line) as line, any_value(m) as m from cg group by w, r, result, moves)"""
