"""Sequences -> states (SEQ) and opening names (OPN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.functions import columns as C
from ludograph.functions.hashing import position_hash, text_key, to_hex
from ludograph.operators import openings as O
from ludograph.operators import sequences as S
from ludograph.operators.replay import index_rows, plies, replay_games
from ludograph.sources.openings import openings_from_lines


def played(spark, d):
    return replay_games(V.chess(spark, d))


_PLAYED = f"""{V.CHESS},
ply as (select id, unnest(range(0, cast(m + 1 as bigint))) as ply, line, m, broken, ucis, sans from c)"""


@check(
    "seq_01_replay",
    f"""with {_PLAYED} select id, cast(ply as int) as ply, case when ply < m then ucis[ply + 1] end as uci,
    case when ply < m then sans[ply + 1] end as san,
    case when broken and ply = m then 'illegal move "{V.ILLEGAL}" at ply ' || cast(m + 1 as varchar) end as warning from ply""",
)
def replay(spark, d):
    games = played(spark, d)
    rows = plies(games, "id", "tokens")
    last = games.select("id", F.size("moves").alias("ply"), "warning")
    return rows.select("id", "ply", "uci", "san").join(last, ["id", "ply"], "left")


@check(
    "seq_01b_replay_states",
    # Final positions known from the lines; equal keys exactly where the text is equal.
    f"""with {_PLAYED}, starts as (select case when ply = 0 then 'start' else array_to_string(sans[1:ply], ' ') end as path, line, ply from ply),
    st as (select case
      when path in ('d4 d5 c4 e6', 'c4 e6 d4 d5') then 'qgd'
      when path in ('d4 d5 c4 e6 Nc3', 'c4 e6 d4 d5 Nc3') then 'qgd-nc3'
      when path in ('start', 'Nf3 Nf6 Ng1 Ng8') then 'start'
      when path in ('Nf3 Nf6 Ng1 Ng8 e4', 'e4') then 'e4'
      when path in ('Nf3 Nf6 Ng1 Ng8 e4 e5', 'e4 e5') then 'e4 e5' else path end as state from starts)
    select n, cast(count(*) as bigint) as states from (select state, cast(count(*) as bigint) as n from st group by state) group by n""",
)
def replay_states(spark, d):
    counts = played(spark, d).select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("states"))


@check("seq_02_states", f"with {V.P} select game_id, event_id, cast(ply as bigint) as ply, state from steps")
def states(spark, d):
    return V.steps(spark, d).select("game_id", "event_id", "ply", "state")


_KEY = lambda text, n: f"cast('0x' || substr(md5({text}), 1, {n}) as bigint)"


@check(
    "seq_02b_states_path",
    f"""with {V.EV}, n as (select game_id, event_id, step, row_number() over (partition by game_id order by ts, event_id) - 1 as ply, ts from ev)
    select game_id, event_id, cast(ply as bigint) as ply,
      coalesce(bit_xor({_KEY("cast(ply as varchar) || '|' || step", 15)}) over
        (partition by game_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as state from n""",
)
def states_path(spark, d):
    ev = V.events(spark, d)
    return S.states(ev, ["game_id"], V.ORDER, "step", mode="path", bucket=V.minute()).select("game_id", "event_id", "ply", "state")


@check(
    "seq_02c_states_bag_key",
    f"""with {V.EV} select game_id, event_id,
      cast(coalesce(sum({_KEY("step", 9)}) over
        (partition by game_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as state from ev""",
)
def states_bag_key(spark, d):
    ev = V.events(spark, d)
    return S.states(ev, ["game_id"], V.ORDER, "step", bucket=V.minute()).select("game_id", "event_id", "state")


@check(
    "seq_03_state_hash",
    f"with {V.EV} select game_id, bit_xor({_KEY('step || cast(event_id as varchar)', 15)}) as hash from ev group by game_id",
)
def state_hash(spark, d):
    ev = V.events(spark, d)
    key = text_key(F.concat(F.col("step"), F.col("event_id").cast("string")))
    return S.step_hash(ev.select("game_id", key.alias("key")), ["game_id"], "key")


@check(
    "seq_03b_position_hash",
    f"with {_PLAYED} select id, cast(ply as int) as ply, true as same, 16 as digits from ply",
)
def hash_of_text(spark, d):
    """The key worked out from a position's text equals the one kept during the replay."""
    rows = plies(played(spark, d), "id")
    return rows.select(
        "id", "ply", (position_hash("epd") == F.col("hash")).alias("same"),
        F.length(to_hex("hash")).alias("digits"),
    )


@check(
    "seq_04_with_next",
    f"""with {V.EV} select game_id, event_id, coalesce(lead(step) over (partition by game_id order by ts, event_id), '{V.END}') as next from ev""",
)
def with_next(spark, d):
    ev = V.events(spark, d)
    return S.with_next(ev, ["game_id"], V.ORDER, "step", end=V.END, bucket=V.minute()).select("game_id", "event_id", "next")


@check("seq_05_horizon", f"with {V.P} select game_id, cast(ply as bigint) as ply, hash, move from plies where ply <= 3")
def horizon(spark, d):
    return S.horizon(V.plies(spark, d), 3).select("game_id", "ply", "hash", "move")


@check(
    "seq_06_first_visit",
    f"""with {V.P} select game_id, step as hash, cast(min(ply) as bigint) as ply, arg_min(event_id, ply) as event_id
    from steps group by game_id, step""",
)
def first_visit(spark, d):
    rows = V.steps(spark, d).select("game_id", F.col("step").alias("hash"), "ply", "event_id")
    return S.first_visit(rows, ["game_id"])


@check("seq_07_position_index", f"with {V.P} select hash, move, game_id, cast(ply as bigint) as ply, result, elo, year from p")
def position_index(spark, d):
    return V.positions(spark, d)


@check(
    "seq_07b_chess_index",
    f"""with {_PLAYED},
    firsts as (select id, ply, case when ply < m then ucis[ply + 1] else '{V.END}' end as uci from ply
      where ply <= 8 and not (line = 6 and ply = 4))
    select id, cast(ply as int) as ply, uci from firsts""",
)
def chess_index(spark, d):
    """State rows built inside each game's row: horizon 8, first visits (line 7 returns to the start)."""
    rows = played(spark, d).select("id", F.inline(index_rows(8)))
    return rows.select("id", "ply", F.when(F.col("move") == C.MOVE_END, V.END).otherwise(C.move_to_uci("move")).alias("uci"))


@check(
    "seq_08_move_keys",
    """select event_id, cast(user_id % 64 + (event_id % 64) * 64 + (case when event_id % 7 = 0 then 5 else 0 end) * 4096 as int) as move,
      case when user_id % 64 + (event_id % 64) * 64 + (case when event_id % 7 = 0 then 5 else 0 end) * 4096 = 0 then '0000' else
        substr('abcdefgh', cast(user_id % 8 + 1 as int), 1) || cast((user_id % 64) // 8 + 1 as varchar)
        || substr('abcdefgh', cast(event_id % 8 + 1 as int), 1) || cast((event_id % 64) // 8 + 1 as varchar)
        || case when event_id % 7 = 0 then 'q' else '' end end as uci, true as back from events""",
)
def move_keys(spark, d):
    ev = V.table(spark, d, "events")
    promo = F.when(F.col("event_id") % 7 == 0, 5).otherwise(0)
    key = C.move_key((F.col("user_id") % 64).cast("int"), (F.col("event_id") % 64).cast("int"), promo)
    rows = ev.select("event_id", key.alias("move")).withColumn("uci", C.move_to_uci("move"))
    return rows.withColumn("back", C.uci_to_move("uci") == F.col("move"))


@check(
    "seq_09_pack",
    f"with {V.P} select game_id, cast(ply // 1024 as int) as piece, string_agg(step, ' ' order by ply) as moves, cast(count(*) as int) as n from steps group by 1, 2",
)
def pack(spark, d):
    packed = S.pack(V.steps(spark, d).select("game_id", "ply", "step"), ["game_id"], "step")
    piece = F.floor(F.col("ply") / S.PIECE).cast("int").alias("piece")
    back = S.unpack(packed, "moves", "step").groupBy("game_id", piece).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return packed.select("game_id", "piece", F.array_join("moves", " ").alias("moves")).join(back, ["game_id", "piece"])


@check(
    "seq_10_start_ply",
    """select o_orderkey as id, cast((case when o_orderkey % 300 = 0 then 1 else o_orderkey % 300 end - 1) * 2
      + case when o_orderkey % 3 = 0 then 1 else 0 end as int) as ply, 0 as bare from orders""",
)
def start_ply(spark, d):
    k = F.col("o_orderkey")
    side = F.when(k % 3 == 0, " b").otherwise(" w")
    fen = F.concat(F.lit("8/8/8/4k3/8/8/4P3/4K3"), side, F.lit(" - - 0 "), (k % 300).cast("string"))
    return V.table(spark, d, "orders").select(
        k.alias("id"), C.start_ply(fen).alias("ply"), C.start_ply(F.lit("8/8/8/4k3/8/8/4P3/4K3 w - -")).alias("bare")
    )


@check(
    "seq_11_ending_kind",
    f"""with {V.CHESS} select id, case when line = 7 and m = 4 then 'mate' end as ending from c""",
)
def ending_kind(spark, d):
    games = played(spark, d)
    token = F.get("tokens", F.size("moves") - 1)
    epd = F.concat(C.pack_board(F.element_at("boards", -1)), F.element_at("sides", -1))
    return games.select("id", C.ending_kind(token, epd).alias("ending"))


@check(
    "seq_11b_material",
    """select o_orderkey as id, case cast(o_orderkey % 6 as int) when 0 then true when 1 then true when 2 then true when 3 then
      (o_orderkey // 8) % 8 % 2 = 0 else false end as insufficient from orders""",
)
def material(spark, d):
    """Bare kings, one minor piece, bishops on equal or different colours, knights, a pawn."""
    k = F.col("o_orderkey")
    file = ((F.floor(k / 8)) % 8).cast("int")
    # A bishop on a8 and another one on some square of the same rank.
    other = F.concat(F.repeat(F.lit("."), file), F.lit("b"), F.repeat(F.lit("."), (F.lit(7) - file)))
    rank = lambda text: C.pack_board(F.rpad(text, 64, "."))
    first = F.when(k % 6 == 0, rank(F.lit("........"))).when(k % 6 == 1, rank(F.lit("n......."))).when(
        k % 6 == 2, rank(F.lit("B.......")))
    first = first.when(k % 6 == 3, rank(F.concat(F.lit("B......." + "." * 8), other)))
    first = first.when(k % 6 == 4, rank(F.lit("NN......"))).otherwise(rank(F.lit("........P")))
    return V.table(spark, d, "orders").select(
        k.alias("id"), C.insufficient_material(F.concat(first, F.lit(" w - -"))).alias("insufficient")
    )


@check(
    "seq_12_epd_key",
    """select o_orderkey as id, o_orderstatus || '/' || replace(o_orderpriority, ' ', '_') || ' w ' || cast(o_custkey as varchar) || ' -' as epd from orders""",
)
def epd_key(spark, d):
    text = F.concat(
        F.col("o_orderstatus"), F.lit("/"), F.translate("o_orderpriority", " ", "_"), F.lit(" w  "), F.col("o_custkey").cast("string"),
        F.lit(" - "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" 17"),
    )
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.epd_key(text).alias("epd"))


@check(
    "seq_13_validate",
    """select o_orderkey as id, case cast(o_orderkey % 8 as int)
      when 0 then 'not a game: no tags and no moves'
      when 1 then 'unsupported variant atomic'
      when 2 then 'invalid start position' when 3 then 'invalid start position'
      when 4 then 'invalid start position' when 5 then 'invalid start position' end as reason from orders""",
)
def validate(spark, d):
    k = F.col("o_orderkey") % 8
    variant = F.when(k == 1, "Atomic").when(k == 7, "From Position").otherwise("Standard")
    tags = F.when(k == 0, F.map_filter(F.create_map(F.lit("a"), F.lit("b")), lambda a, b: F.lit(False))).otherwise(
        F.create_map(F.lit("Variant"), variant, F.lit("Round"), F.col("o_orderkey").cast("string"))
    )
    fen = (
        F.when(k == 2, "8/8/8/4k3/8/8/4P3 w - - 0 1")  # a rank is missing
        .when(k == 3, "8/8/8/4k3/8/8/4P4/4K3 w - - 0 1")  # nine files
        .when(k == 4, "8/8/8/8/8/8/4P3/4K3 w - - 0 1")  # no black king
        .when(k == 5, "4k2p/8/8/8/8/8/8/4K3 x - - 0 1")  # pawn on the last rank, odd side
        .when(k == 6, "8/8/8/4k3/8/8/4P3/4K3 w - -")
    )
    moves = F.when(k == 0, 0).otherwise(3)
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.validate(tags, fen, moves).alias("reason"))


# ---- opening names ---------------------------------------------------------------------------

_DEPTHS = [(eco, name, moves, len(moves.split())) for eco, name, moves in V.NAMED]
# Which named lines a game's line passes, and at which ply (one transposition: line 3 joins the QGD).
_HITS = [
    (i, n, eco, name.replace("'", "''"))
    for i, (sans, _) in enumerate(V.LINES)
    for eco, name, moves, n in _DEPTHS
    if (sans + " ").startswith(moves + " ")
] + [(3, 4, "D30", "Queen''s Gambit Declined"), (6, 5, "B00", "King''s Pawn"), (6, 6, "C20", "Open Game")]
_HIT_SQL = f"hits as (select * from (values {', '.join(f'({i}, {n}, {chr(39)}{e}{chr(39)}, {chr(39)}{m}{chr(39)})' for i, n, e, m in _HITS)}) as t(hline, hply, eco, name))"


@check(
    "opn_01_classify",
    f"""with {V.CHESS}, {_HIT_SQL} select id, arg_max(eco, hply) as opening_eco, arg_max(name, hply) as opening, cast(max(hply) as int) as named_ply
    from c join hits on hline = line and hply <= m group by id""",
)
def classify(spark, d):
    ref = openings_from_lines(V.named_lines(spark))
    rows = played(spark, d).select("id", F.posexplode("hashes").alias("ply", "hash"))
    return O.classify(rows, ref, ["id"])


def state_names(spark, d):
    """A reference table over event states: the shortest day that reaches a state names it."""
    last = V.plies(spark, d).filter((F.col("ply") <= 2) & (F.col("ply") >= 1))
    return last.groupBy("hash").agg(F.min("ply").alias("plies")).select(
        F.substring("hash", 1, 3).alias("eco"), F.concat(F.lit("state "), F.col("hash")).alias("name"), "hash"
    )


_NAMES = "ref as (select hash, substr(hash, 1, 3) as eco, 'state ' || hash as name from plies where ply between 1 and 2 group by hash)"


@check(
    "opn_01b_classify_states",
    f"""with {V.P}, {_NAMES} select game_id, arg_max(r.eco, ply) as opening_eco, arg_max(r.name, ply) as opening, cast(max(ply) as bigint) as named_ply
    from plies q join ref r on r.hash = q.hash where ply between 1 and 40 group by game_id""",
)
def classify_states(spark, d):
    return O.classify(V.plies(spark, d), state_names(spark, d), ["game_id"])


@check("opn_02_name_states", f"with {V.P}, {_NAMES} select q.game_id, cast(q.ply as bigint) as ply, r.eco, r.name from p q left join ref r on r.hash = q.hash")
def name_states(spark, d):
    return O.name_states(V.positions(spark, d), state_names(spark, d)).select("game_id", "ply", "eco", "name")


@check(
    "opn_03_nearest_named",
    f"""with {V.P}, {_NAMES} select game_id, event_id, last_value(r.name ignore nulls) over
      (partition by game_id order by ts, event_id rows between unbounded preceding and current row) as near_name
    from steps q left join ref r on r.hash = q.state""",
)
def nearest_named(spark, d):
    rows = V.steps(spark, d).withColumnRenamed("state", "hash")
    out = O.nearest_named(rows, state_names(spark, d), ["game_id"], V.ORDER, bucket=V.minute())
    return out.select("game_id", "event_id", "near_name")


@check(
    "opn_04_opening_dim",
    f"with {V.G} select opening as name, arg_min(eco, id) as eco, cast(row_number() over (order by min(id)) as bigint) as id from g where opening is not null group by opening",
)
def opening_dim(spark, d):
    from ludograph.operators.dims import opening_dim as build

    g = V.games(spark, d)
    return build(g.select(F.col("id").alias("seq"), "opening", F.col("eco").alias("opening_eco")), "seq")
