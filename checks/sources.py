"""Reading and writing records (SRC, SNK) and the whole import."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.functions import columns as C
from ludograph.functions import text as X
from ludograph.operators import reports
from ludograph.operators.explorer import explore
from ludograph.operators.jobs import StepCounts
from ludograph.operators.openings import build_openings, name_states
from ludograph.operators.replay import BoardStates
from ludograph.plans.export import export_ids, export_pgn, record_text
from ludograph.plans.ingest import Options, ingest
from ludograph.plans.tables import Store, Tables
from ludograph.sources import records as R
from ludograph.sources.openings import openings_from_lines, read_openings


def _write_records(rows, path, key="k"):
    """Record files of several records each."""
    rows.repartitionByRange(4, key).sortWithinPartitions(key).select("raw").write.option("lineSep", "\n").text(path)


def _seen(rows):
    tags = rows.select(X.tags("raw").alias("t"), X.movetext("raw").alias("body"))
    return tags.select(
        F.element_at("t", "Round").cast("bigint").alias("k"), F.element_at("t", "White").alias("white"),
        F.array_join(X.mainline_tokens("body"), " ").alias("tokens"),
    )


_READ = f"with {V.R}, t as (select k, string_agg(tok, ' ' order by i) as tokens from m group by k) select t.k, white, tokens from t join r on r.k = t.k"


@check("src_01_read_records", _READ)
def read_fast(spark, d):
    path = V.scratch(spark)
    _write_records(V.records(spark, d), path)
    return _seen(R.read_records(spark, path))


@check("src_01b_read_strict", _READ)
def read_strict(spark, d):
    path = V.scratch(spark)
    _write_records(V.records(spark, d), path)
    return _seen(R.read_records(spark, path, strict=True))


@check("src_01c_record_numbers", f"with {V.R} select k, cast(row_number() over (order by k) as bigint) as pos from r")
def record_numbers(spark, d):
    """Records are numbered in file order (the files are ranges of k)."""
    path = V.scratch(spark)
    _write_records(V.records(spark, d), path)
    rows = R.numbered_records(R.read_records(spark, path))
    return rows.select(F.element_at(X.tags("raw"), "Round").cast("bigint").alias("k"), "pos")


@check("src_02_decode", "select doc_id, md5(replace(text, chr(13), '')) as text from documents")
def decode(spark, d):
    docs = V.table(spark, d, "documents")
    western = (F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"^[\x{00}-\x{7f}\x{a0}-\x{ff}]*\z")
    raw = F.when(western, F.encode("text", "ISO-8859-1")).otherwise(
        F.encode(F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n"))), "UTF-8")
    )
    return docs.select("doc_id", F.md5(R.decode_text(raw)).alias("text"))


@check("src_03_texts", _READ)
def texts(spark, d):
    """Uploads of ten records each."""
    rows = V.records(spark, d)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "raw"))), lambda r: r["raw"])
    # Keys are unique, so an upload holds at most ten records.
    uploads = rows.groupBy(F.floor(F.col("k") / 10).alias("name")).agg(F.array_join(parts, "\n").alias("text"))
    return _seen(R.records_of_texts(uploads))


@check("src_04_read_openings", "select 'A' || lpad(cast(p_size as varchar), 2, '0') as eco, p_name || ' ' || cast(p_partkey as varchar) as name, p_partkey * 1000003 - 7 as hash from part")
def openings(spark, d):
    path = V.scratch(spark)
    part = V.table(spark, d, "part")
    line = F.concat_ws(
        "\t", F.concat(F.lit("A"), F.lpad(F.col("p_size").cast("string"), 2, "0")),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), F.lower(F.hex(F.col("p_partkey") * 1000003 - 7)),
    )
    part.select(line).write.text(path)
    return read_openings(spark, path)


@check(
    "src_05_build_openings",
    f"""with {V.P}, c as (select hash, ply, 'game ' || cast(game_id as varchar) as name, cast(result as varchar) as eco from p where ply >= 1),
    k as (select *, row_number() over (partition by hash order by ply, name, eco) as rn from c)
    select hash, eco, name, cast(ply as bigint) as plies from k where rn = 1""",
)
def shortest_lines(spark, d):
    """Per state the shortest day that reaches it (ties by name)."""
    p = V.positions(spark, d).filter(F.col("ply") >= 1)
    lines = p.select(
        "hash", F.col("ply").alias("plies"), F.concat(F.lit("game "), F.col("game_id").cast("string")).alias("name"),
        F.col("result").cast("string").alias("eco"),
    )
    return build_openings(lines)


_GAMES = f"""with {V.CHESS_GAMES}, {{hits}},
  op as (select id, arg_max(name, hply) as opening, arg_max(eco, hply) as eco from kept join hits on hline = line and hply <= m group by id)
  select 'Player ' || cast(w as varchar) as white, 'Guest ' || cast(r as varchar) as black, cast(r as varchar) as round, result, cast(m as int) as plies, moves, opening, eco
  from kept left join op on op.id = kept.id"""


def _hits():
    from checks.sequences import _HIT_SQL

    return _HIT_SQL


def _uci(rows):
    return F.array_join(F.transform("moves", lambda m: C.move_to_uci(m)), " ").alias("moves")


def _facts(games):
    return games.select(
        "white", "black", "round", F.col("result").cast("int").alias("result"), F.col("ply_count").alias("plies"), _uci(games), "opening", "eco"
    )


@check("ingest_01_games", _GAMES.format(hits=_hits()))
def ingest_games(spark, d):
    """Record texts -> replayed, named, de-duplicated games."""
    path = V.scratch(spark)
    _write_records(V.chess_records(spark, d), path)
    done = ingest(R.read_records(spark, path), openings_from_lines(V.named_lines(spark)), states=BoardStates())
    return _facts(done.games)


@check(
    "ingest_02_positions",
    f"""with {V.CHESS_GAMES}, s as (select id, result, line, m, unnest(range(0, cast(m + 1 as bigint))) as ply from kept)
    select cast(ply as int) as ply, result, cast(count(*) as bigint) as n, cast(sum(case when ply = m then 1 else 0 end) as bigint) as ended
    from s where not (line = 6 and ply = 4) group by 1, 2""",
)
def ingest_positions(spark, d):
    path = V.scratch(spark)
    _write_records(V.chess_records(spark, d), path)
    done = ingest(R.read_records(spark, path), states=BoardStates())
    # Line 7 is back at the start after four plies; games that end there have no row for it.
    return done.positions.groupBy("ply", F.col("result").cast("int").alias("result")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("move") == C.MOVE_END).cast("bigint")).alias("ended")
    )


@check(
    "ingest_03_report",
    f"""with {V.CHESS_GAMES} select cast(0 as bigint) as batch, (select cast(count(*) as bigint) from kept) as imported,
      (select cast(count(*) as bigint) from c) - (select cast(count(*) as bigint) from kept) as duplicates, cast(0 as bigint) as errors,
      (select cast(sum(case when broken then 1 else 0 end) as bigint) from c) as warnings""",
)
def ingest_statuses(spark, d):
    path = V.scratch(spark)
    _write_records(V.chess_records(spark, d), path)
    done = ingest(R.read_records(spark, path), states=BoardStates())
    return reports.ingest_report(done.statuses).drop("samples")


@check("src_06_stream", _GAMES.format(hits=_hits()))
def stream(spark, d):
    """Files land in two drops; each is taken in once, checked against what is stored."""
    from ludograph.streaming.arrivals import ingest_stream

    rows = V.chess_records(spark, d)
    base = V.scratch(spark)
    store = Store(spark, f"{base}/tables")
    names = openings_from_lines(V.named_lines(spark))
    half = rows.agg(F.max("k")).first()[0] // 2
    for part in (rows.filter(F.col("k") <= half), rows.filter(F.col("k") > half)):
        part.repartitionByRange(2, "k").sortWithinPartitions("k").select("raw").write.mode("append").text(f"{base}/landing")
        ingest_stream(spark, f"{base}/landing/*.txt", store, f"{base}/progress", openings=names, states=BoardStates()).awaitTermination()
    return _facts(store.read().games)


# ---- sessions of events as records, with native states ------------------------------------------

JOB = StepCounts(vocabulary=tuple(V.STEPS))
_LINES = [("A01", "First look", "view"), ("A02", "Look and click", "view click"), ("B01", "Error at once", "error"),
          ("B02", "Two errors", "1. error error"), ("C01", "Bought blind", "purchase"), ("C02", "All but signup", "click error purchase view")]


def _line_state(moves: str) -> str:
    return "|".join(str(moves.split().count(w)) for w in V.STEPS)


_NAMED = ", ".join(f"('{eco}', '{name}', '{_line_state(moves)}')" for eco, name, moves in _LINES)


def session_records(spark, d):
    """(k, raw): the steps of each user day as one record."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "step")))
    text = V.events(spark, d).groupBy("game_id").agg(F.transform(steps, lambda s: s["step"]).alias("steps"))
    facts = V.sessions(spark, d).select("game_id", "result")
    k = F.col("game_id")
    date = F.concat_ws(".", F.floor(k / 10000) % 10000, F.lpad((F.floor(k / 100) % 100).cast("string"), 2, "0"), F.lpad((k % 100).cast("string"), 2, "0"))
    tag = lambda name, value: F.concat(F.lit(f'[{name} "'), value, F.lit('"]\n'))
    half = F.ceil(F.size("steps") / 2).cast("int")
    body = F.concat(F.lit("1. "), F.array_join(F.slice("steps", F.lit(1), half), " "), F.lit(" {half way}\n2. "),
                    F.array_join(F.slice("steps", half + 1, F.size("steps")), " "), F.lit(" "), C.result_text("result"), F.lit("\n"))
    return text.join(facts, "game_id").select(k.alias("k"), F.concat(
        tag("Event", F.concat(F.lit("Day "), (k % 100).cast("string"))), tag("White", F.concat(F.lit("User "), F.floor(k / 100000000).cast("string"))),
        tag("Round", k.cast("string")), tag("Date", date), tag("Result", C.result_text("result")), F.lit("\n"), body).alias("raw"))


_SESSION_GAMES = f"""with {V.P}, ref(eco, name, state) as (values {_NAMED}),
  op as (select game_id, arg_max(name, ply) as opening, arg_max(eco, ply) as eco from p join ref on state = hash where ply between 1 and 40 group by game_id)
  select f.game_id as session, 'User ' || cast(f.game_id // 100000000 as varchar) as white, 'Day ' || cast(f.game_id % 100 as varchar) as event,
    cast(f.game_id % 100000000 as bigint) as date, cast(f.result as bigint) as result, cast(f.n as bigint) as plies, opening, eco
  from facts f left join op on op.game_id = f.game_id"""


def _session_facts(games):
    return games.select(F.col("round").cast("bigint").alias("session"), "white", "event", F.col("date").cast("bigint").alias("date"),
                        F.col("result").cast("bigint").alias("result"), F.col("ply_count").cast("bigint").alias("plies"), "opening", "eco")


def _imported(spark, d, options=Options(), path=None):
    if path is None:
        path = V.scratch(spark)
        _write_records(session_records(spark, d), path)
    lines = spark.createDataFrame(_LINES, "eco string, name string, moves string")
    return ingest(R.read_records(spark, path), JOB.named(lines), options, states=JOB)


def _by_session(positions, games):
    rows = positions.join(games.select(F.col("id").alias("game_id"), F.col("round").cast("bigint").alias("session")), "game_id")
    return rows.select("hash", "move", "session", F.col("ply").cast("bigint").alias("ply"), F.col("result").cast("bigint").alias("result"))


@check("ingest_04_sessions", _SESSION_GAMES)
def import_sessions(spark, d):
    """Record texts -> counted, named, de-duplicated sessions; native all the way."""
    return _session_facts(_imported(spark, d).games)


_SESSION_STATES = f"with {V.P} select hash, move, game_id as session, cast(ply as bigint) as ply, cast(result as bigint) as result from p"


@check("ingest_05_session_states", _SESSION_STATES)
def import_session_states(spark, d):
    done = _imported(spark, d)
    return _by_session(done.positions, done.games)


@check("snk_02b_round_trip", _SESSION_GAMES)
def round_trip(spark, d):
    """Whole records written from steps, with tags, numbers and line breaks, and imported again."""
    path = V.scratch(spark)
    export_pgn(record_text(_imported(spark, d, Options(strip=True)).games), path)
    return _session_facts(_imported(spark, d, path=path).games)


@check("snk_03b_round_trip_ids", _SESSION_GAMES + " where f.game_id % 4 = 1")
def round_trip_ids(spark, d):
    """The same for a list of ids."""
    path, games = V.scratch(spark), _imported(spark, d).games
    listed = games.where(F.col("round").cast("bigint") % 4 == 1).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"))
    export_pgn(export_ids(listed, record_text(games)).select("id", "record"), path)
    return _session_facts(_imported(spark, d, path=path).games)


@check("ingest_06_stored_index", f"with {V.P} select cast(count(*) as bigint) as positions, (select cast(count(*) as bigint) from facts) as games from p")
def import_stored_index(spark, d):
    """The whole import with games and state index written and sorted."""
    store, done = Store(spark, V.scratch(spark)), _imported(spark, d)
    store.append(Tables(done.games, done.positions))
    return store.meta().select("positions", "games")


@check("src_06b_session_stream", _SESSION_GAMES)
def session_stream(spark, d):
    """Sessions land in two drops, the second with some of the first again."""
    from ludograph.streaming.arrivals import ingest_stream

    rows = session_records(spark, d)
    base = V.scratch(spark)
    store = Store(spark, f"{base}/tables")
    names = JOB.named(spark.createDataFrame(_LINES, "eco string, name string, moves string"))
    for part in (rows.filter(F.col("k") % 3 != 0), rows.filter(F.col("k") % 3 != 1)):
        part.repartitionByRange(2, "k").sortWithinPartitions("k").select("raw").write.mode("append").text(f"{base}/landing")
        ingest_stream(spark, f"{base}/landing/*.txt", store, f"{base}/progress", openings=names, states=JOB).awaitTermination()
    return _session_facts(store.read().games)


@check("opn_01c_session_names", f"with {V.P}, ref(eco, name, state) as (values {_NAMED}) select game_id as session, cast(ply as bigint) as ply, name from p left join ref on state = hash")
def session_names(spark, d):
    """Every state of the imported sessions with its name, if it has one."""
    done = _imported(spark, d)
    named = name_states(done.positions, JOB.named(spark.createDataFrame(_LINES, "eco string, name string, moves string")))
    return named.join(
        done.games.select(F.col("id").alias("game_id"), F.col("round").cast("bigint").alias("session")), "game_id").select(
        "session", F.col("ply").cast("bigint").alias("ply"), "name")


@check("exp_10b_enter_line", f"""with {V.P} select move, cast(count(*) as bigint) as games, cast(sum(case when result = 1 then 1 else 0 end) as bigint) as white
  from p where hash = '{_line_state('view click view')}' group by move""")
def enter_line(spark, d):
    """The next steps of those who did these three steps, typed as a line."""
    done = _imported(spark, d)
    table = explore(done.positions, JOB.state_of(["view", "click", "view"]))
    return table.select("move", F.col("games").cast("bigint").alias("games"), F.col("white").cast("bigint").alias("white"))


# ---- sinks ----------------------------------------------------------------------------------------


@check("snk_01_tables", f"with {V.P} select hash, move, game_id, cast(ply as bigint) as ply, result, elo, year from p")
def write_tables(spark, d):
    from ludograph.plans.tables import Tables

    store = Store(spark, V.scratch(spark))
    facts = V.sessions(spark, d).select(F.col("game_id").alias("id"), F.col("year").alias("date"), "result", "elo")
    store.append(Tables(facts, V.positions(spark, d)), V.HORIZON)
    return store.read().positions


@check(
    "snk_01b_unique",
    f"with {V.P} select cast(count(*) as bigint) as n, cast(count(distinct (hash, move, game_id)) as bigint) as keys, (select cast(count(*) as bigint) from facts) as games from p",
)
def unique_keys(spark, d):
    from ludograph.plans.tables import Tables

    store = Store(spark, V.scratch(spark))
    facts = V.sessions(spark, d).select(F.col("game_id").alias("id"), F.col("year").alias("date"), "result", "elo")
    store.append(Tables(facts, V.positions(spark, d)), V.HORIZON)
    keys = store.read().positions.groupBy("hash", "move", "game_id").agg(F.count(F.lit(1)).alias("n"))
    return spark.sql(
        "select sum(n) as n, count(*) as keys, (select max(games) from {m}) as games from {k}", k=keys, m=store.meta()
    )


def _record_sql() -> str:
    from checks.columns import _HEAD

    return f"""{V.G}, {_HEAD}, rec as (select id, string_agg('[' || name || ' "' || replace(replace(value, '\\', '\\\\'), '"', '\\"') || '"]', chr(10) order by o)
      || chr(10) || chr(10) || coalesce(max(movetext), max({V.RESULT_SQL})) || chr(10) as record from hl group by id)"""


@check("snk_02_export", f"with {_record_sql()}, l as (select unnest(string_split(record, chr(10))) as line from rec) select line, cast(count(*) as bigint) as n from l group by line")
def export(spark, d):
    from checks.columns import record

    path = V.scratch(spark)
    export_pgn(record(spark, d), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "snk_03_export_ids",
    f"""with {_record_sql()}, ids as (select case when l_partkey % 7 = 0 then 'x' || cast(l_orderkey as varchar) else cast(l_orderkey * 2 as varchar) end as v,
      l_orderkey * 10000000 + l_partkey as pos from (select distinct l_orderkey, l_partkey from lineitem))
    select pos, rec.id, md5(record) as record from ids join rec on cast(rec.id as varchar) = v""",
)
def ids(spark, d):
    from checks.columns import record

    line = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    v = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("x"), F.col("l_orderkey").cast("string"))).otherwise(
        (F.col("l_orderkey") * 2).cast("string")
    )
    listed = line.select((F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("pos"), v.alias("id"))
    return export_ids(listed, record(spark, d)).select("pos", "id", F.md5("record").alias("record"))


_BAD = "case when n_chars < 300 then 'short' when lang = 'de' then 'language' end"


@check("snk_04_valid", f"select doc_id, cast(null as varchar) as reason from documents where {_BAD} is null union all select doc_id, {_BAD} from documents where {_BAD} is not null")
def split_valid(spark, d):
    reason = F.when(F.col("n_chars") < 300, "short").when(F.col("lang") == "de", "language")
    ok, bad = reports.split_valid(V.table(spark, d, "documents"), reason)
    return ok.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", "reason"))


@check("snk_04b_samples", f"select doc_id, {_BAD} as reason from documents where {_BAD} is not null order by doc_id limit 20")
def samples(spark, d):
    reason = F.when(F.col("n_chars") < 300, "short").when(F.col("lang") == "de", "language")
    return reports.samples(reports.split_valid(V.table(spark, d, "documents"), reason)[1], ["doc_id"]).select("doc_id", "reason")


@check("snk_05_labels", f"""with {V.R} select k, white || ' – ' || black || ' ' || {V.RESULT_SQL} || ' · ' || event || ' "no. ' || k || '" \\ x' as label from r""")
def labels(spark, d):
    return R.list_records(V.records(spark, d)).select("k", "label")
