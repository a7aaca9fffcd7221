"""Records -> games and state index, as one batch plan.

What the steps of a record mean is the business of a state job (``operators.jobs``): native running counts by default,
the chess job of ``operators.replay`` on request. Shuffles: record text is never shuffled. Scanning is a map over the
file splits; its rows are staged once, because numbers, duplicates, names and the index all read them. Numbers, the
duplicate check and names work on a narrow frame (seq, fingerprint, states), and whole game rows are joined to the
narrow result (seq, id, opening) once. State rows are made by the job from the kept games.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.functions import columns as C
from ludograph.functions import text as X
from ludograph.operators.dims import dedupe, game_fingerprint, only_new
from ludograph.operators.openings import classify
from ludograph.operators.jobs import StateJob, StepCounts
from ludograph.operators.skew import numbered
from ludograph.session import staged
from ludograph.sources.records import numbered_records


@dataclass(frozen=True)
class Options:
    horizon: int = 60
    strip: bool = False  # drop comments, codes and variations
    dedupe: bool = True
    headerless: bool = True  # keep games without tags that follow another game's result
    reject_warned: bool = False  # an illegal move rejects the record instead of cutting it

    def __post_init__(self) -> None:
        if not 0 <= self.horizon <= 400:
            raise ValueError("the horizon must lie in 0..400")


@dataclass(frozen=True)
class Ingested:
    games: DataFrame
    positions: DataFrame
    statuses: DataFrame  # batch, seq, file, block, line, status (ok, duplicate, error), message, warning


PLACE = ["file", "block", "line"]
SUB_BITS = 20  # room for games without tags inside one record


def scan(records: DataFrame, options: Options = Options(), job: StateJob = StepCounts()) -> DataFrame:
    """(file, block, line, raw) -> one row per game with tags, tokens, movetext if annotated, result."""
    place = ["file", "block", "line"]
    rows = records.select(*place, "raw", X.tag_section("raw").alias("head"))
    rows = rows.select(*place, X.tags_of(F.col("head")).alias("tags"), X.body_of(F.col("raw"), F.col("head")).alias("body"))
    rows = rows.select(*place, "tags", F.posexplode(X.split_by_result("body")).alias("sub", "body"))
    rows = rows.filter((F.col("sub") == 0) | (F.col("body") != ""))
    if not options.headerless:
        rows = rows.filter(F.col("sub") == 0)
    none = F.map_filter("tags", lambda k, v: F.lit(False))
    rows = rows.withColumn("main", X.mainline_text("body"))
    return rows.select(
        *place, "sub",
        F.when(F.col("sub") == 0, F.col("tags")).otherwise(none).alias("tags"),
        (F.col("sub") > 0).alias("headerless"),
        job.tokens(F.col("main")).alias("tokens"),
        F.when(X.is_annotated("body"), F.col("body")).alias("movetext"),
        X.result_of(F.col("main")).alias("result_token"),
    )


def played(scanned: DataFrame, job: StateJob = StepCounts()) -> DataFrame:
    """Validate and let the job play the steps; rows keep their columns."""
    start = F.element_at("tags", "FEN")
    start = F.when(start != "", start)
    rows = scanned.withColumn("start_state", start)
    rows = rows.withColumn("reason", job.reason(F.col("tags"), F.col("start_state"), F.size("tokens")))
    # Rejected rows keep their place but are not played.
    rows = rows.withColumn("tokens", F.when(F.col("reason").isNull(), F.col("tokens")))
    rows = rows.withColumn("start_state", F.when(F.col("reason").isNull(), F.col("start_state")))
    return job.play(rows)


def facts(played: DataFrame, options: Options = Options(), carried: tuple[str, ...] = ()) -> DataFrame:
    """Header facts as typed columns. ``reason`` says why a row is not stored."""
    tag = lambda name: F.element_at("tags", name)
    junk = (F.size("tags") == 0) & (F.coalesce(F.size("moves"), F.lit(0)) <= 0)
    reason = F.coalesce("reason", "error", F.when(junk, F.concat_ws(": ", F.lit("not a game"), "warning")))
    if options.reject_warned:
        reason = F.coalesce(reason, F.col("warning"))
    keep_text = F.lit(not options.strip) & F.col("warning").isNull()
    elo_w, elo_b = C.parse_rating(tag("WhiteElo")), C.parse_rating(tag("BlackElo"))
    date = C.first_date(tag("Date"), tag("UTCDate"), tag("EventDate"))
    rows = played.select(
        "file", "block", "line", "sub", "headerless",
        F.coalesce(C.clean(tag("White")), F.lit("?")).alias("white"),
        F.coalesce(C.clean(tag("Black")), F.lit("?")).alias("black"),
        C.clean(tag("Event")).alias("event"),
        C.clean(tag("Site")).alias("site"),
        date.alias("date"),
        C.clean(tag("Round")).alias("round"),
        C.result_code(F.coalesce(tag("Result"), F.col("result_token"))).alias("result"),
        elo_w.alias("white_elo"),
        elo_b.alias("black_elo"),
        F.upper(C.clean(tag("ECO"))).alias("eco_tag"),
        F.size("moves").alias("ply_count"),
        F.col("start_text").alias("start_state"), "moves", *carried, "tokens",
        F.when(keep_text, F.col("movetext")).alias("movetext"),
        C.extra_tags("tags").alias("tags"),
        F.coalesce(tag("Event"), F.lit("")).alias("event_tag"),
        F.coalesce(tag("Round"), F.lit("")).alias("round_tag"),
        "warning", reason.alias("reason"),
    )
    rows = rows.withColumn("sans", F.slice("tokens", 1, F.greatest("ply_count", F.lit(0)))).drop("tokens")
    return rows.select(
        "*",
        C.year_of("date").alias("year"),
        C.min_rating("white_elo", "black_elo").alias("min_elo"),
        C.max_rating("white_elo", "black_elo").alias("max_elo"),
        C.mean_rating("white_elo", "black_elo").alias("elo"),
        game_fingerprint().alias("fingerprint"),
    ).drop("event_tag", "round_tag")


def ingest(
    records: DataFrame, openings: DataFrame | None = None, options: Options = Options(), *,
    states: StateJob = StepCounts(), stored: DataFrame | None = None, first_id: int = 1, batch: int = 0, stage=staged,
) -> Ingested:
    """The whole import of one batch of (file, block, line, raw) records.

    ``states`` is the job that plays the steps, ``openings`` names some of its states. ``stored`` holds the fingerprints
    of earlier games; ``stage`` materialises a frame once in a shared folder.
    """
    rows = _with_seq(stage(facts(played(scan(records, options, states), states), options, states.carried)))
    good = rows.filter(F.col("reason").isNull())
    narrow = good.select("seq", "fingerprint")
    if options.dedupe:
        narrow = dedupe(narrow, "fingerprint", "seq")
        if stored is not None:
            narrow = only_new(narrow, stored)
    # Blocks of about 65,536 records each.
    narrow = numbered(narrow.select("seq"), "seq", "id", first_id, width=65_536 << SUB_BITS)
    if openings is not None:
        usual = good.filter(F.col("start_state").isNull()).select("seq", "moves", *states.carried)
        narrow = narrow.join(classify(states.state_rows(usual, ["seq"], 40, first=False), openings, ["seq"]).drop("named_ply"), "seq", "left")
    else:
        none = F.lit(None).cast("string")
        narrow = narrow.select("*", none.alias("opening_eco"), none.alias("opening"))
    narrow = stage(narrow)
    games = stage(good.join(narrow, "seq").withColumn("eco", C.eco_or("eco_tag", "opening_eco")).drop("eco_tag", *PLACE))
    facts_of = ["game_id", "result", "elo", "year"]
    index = states.state_rows(games.withColumnRenamed("id", "game_id"), facts_of, options.horizon)
    positions = index.select("hash", "move", "game_id", "ply", "result", "elo", "year")
    statuses = rows.join(narrow.select("seq", F.lit("ok").alias("_ok")), "seq", "left").select(
        F.lit(batch).cast("bigint").alias("batch"), "seq", *PLACE,
        F.when(F.col("reason").isNotNull(), "error").when(F.col("_ok").isNull(), "duplicate").otherwise("ok").alias("status"),
        F.col("reason").alias("message"),
        F.when(F.col("reason").isNull(), F.col("warning")).alias("warning"),
    )
    return Ingested(games.drop(*states.carried, "reason"), positions, statuses)


def rejected(statuses: DataFrame, records: DataFrame) -> DataFrame:
    """(batch, seq, file, line, message, raw) of the records that were not taken in. Only their places travel: the
    records are read once more, and kept where a place fits."""
    bad = statuses.where(F.col("status") == "error").select("batch", "seq", *PLACE, "message")
    return bad.join(records.select(*PLACE, "raw"), PLACE, "left").drop("block")


def _with_seq(rows: DataFrame) -> DataFrame:
    """One number per game that follows file order."""
    numbers = numbered_records(rows)
    seq = F.shiftleft(F.col("pos"), SUB_BITS).bitwiseOR(F.col("sub"))
    seq = F.when(F.col("sub") < 1 << SUB_BITS, seq).otherwise(F.raise_error(F.lit("too many games in one record")).cast("bigint"))
    return numbers.withColumn("seq", seq).drop("sub", "pos")
