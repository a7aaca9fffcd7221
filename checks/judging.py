"""Judging steps by evaluations (WIN) and reading engine logs (SRC-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks import views as V
from ludograph.functions import scores as S
from ludograph.operators import judging as J
from ludograph.sources.engine_log import parse_engine_log

# An evaluation per step: cp from the event's value and type, every eleventh a mate score.
_CP = "cast(cents * (case step when 'click' then 3 when 'error' then -5 when 'purchase' then 9 when 'signup' then -2 else 1 end) / 50 as int)"
_EVALS = f"""{V.P}, ev2 as (select game_id, ply, event_id, step,
  case when event_id % 11 = 0 then null else cast(floor(cents * (case step when 'click' then 3 when 'error' then -5 when 'purchase' then 9 when 'signup' then -2 else 1 end) / 50.0) as int) end as cp,
  case when event_id % 11 = 0 then cast(event_id % 5 - 2 as int) end as mate from steps),
wc as (select *, case when mate = 0 then sign(coalesce(cp, 0)) when mate is not null then sign(mate)
  else 2 / (1 + exp(-0.00368208 * greatest(-1000, least(1000, coalesce(cp, 0))))) - 1 end as chance from ev2)"""


def evals(spark, d):
    weight = F.when(F.col("step") == "click", 3).when(F.col("step") == "error", -5).when(F.col("step") == "purchase", 9)
    weight = weight.when(F.col("step") == "signup", -2).otherwise(1)
    odd = F.col("event_id") % 11 == 0
    cp = F.floor(F.col("cents") * weight / 50.0).cast("int")
    return V.steps(spark, d).select(
        "game_id", "ply", "event_id", "step", F.when(~odd, cp).alias("cp"),
        F.when(odd, (F.col("event_id") % 5 - 2).cast("int")).alias("mate"),
    )


@check("win_01_chance", f"with {_EVALS} select event_id, cast(round(chance, 6) as double) as chance from wc")
def chance(spark, d):
    return evals(spark, d).select("event_id", F.round(S.winning_chance("cp", "mate"), 6).alias("chance"))


_JUDGED = f"""{_EVALS}, jd as (select a.game_id, a.ply, a.event_id, a.cp, a.mate, (case when a.ply % 2 = 1 then 1.0 else -1.0 end) * (b.chance - a.chance) as drp
  from wc a join wc b on b.game_id = a.game_id and b.ply = a.ply - 1),
jj as (select *, case when drp >= 0.6 then 'blunder' when drp >= 0.4 then 'mistake' when drp >= 0.2 then 'inaccuracy' end as judgement from jd)"""


@check("win_02_judge", f"with {_JUDGED} select game_id, cast(ply as bigint) as ply, judgement, cast(round(drp, 6) + 0.0 as double) as drop from jj")
def judge(spark, d):
    return J.judge(evals(spark, d), ["game_id"]).select("game_id", "ply", "judgement", (F.round("drop", 6) + 0.0).alias("drop"))


_SUM = lambda j: f"cast(sum(case when judgement = '{j}' then 1 else 0 end) as bigint) as {j}"


@check(
    "win_03_counts",
    f"with {_JUDGED} select game_id, case when ply % 2 = 1 then 'white' else 'black' end as side, {_SUM('blunder')}, {_SUM('mistake')}, {_SUM('inaccuracy')} from jj group by 1, 2",
)
def judgement_counts(spark, d):
    return J.judgement_counts(J.judge(evals(spark, d), ["game_id"]), ["game_id"])


_PAWNS = "printf('%.2f', coalesce(cp, 0) / 100.0)"


@check(
    "win_04_score_text",
    f"""with {_EVALS} select event_id, case when mate = 0 then '#' when mate is not null then '#' || cast(mate as varchar)
      when cp > 0 then '+' || {_PAWNS} else {_PAWNS} end as score,
      case when mate = 0 then '' when mate is not null then '#' || cast(mate as varchar) else {_PAWNS} end as eval from ev2""",
)
def score_text(spark, d):
    return evals(spark, d).select("event_id", S.score_text("cp", "mate").alias("score"), S.eval_text("cp", "mate").alias("eval"))


@check(
    "win_05_annotate",
    f"""with {_JUDGED}, an as (select e.game_id, e.ply, e.event_id, e.cp, e.mate, j.judgement,
      case when e.event_id % 3 = 0 then 'good' when e.event_id % 3 = 1 then 'so so' else '' end as bare,
      case when e.mate = 0 then '' when e.mate is not null then '#' || cast(e.mate as varchar) else printf('%.2f', coalesce(e.cp, 0) / 100.0) end as ev,
      b.event_id as prev from ev2 e left join jj j on j.event_id = e.event_id left join ev2 b on b.game_id = e.game_id and b.ply = e.ply - 1 where e.ply >= 1)
    select game_id, cast(ply as bigint) as ply, nullif(trim(bare || case when ev <> '' then ' [%eval ' || ev || ']' else '' end), '') as comment,
      case when event_id % 2 = 0 then '7' || case judgement when 'blunder' then ',4' when 'mistake' then ',2' when 'inaccuracy' then ',6' else ',3' end
           else coalesce(case judgement when 'blunder' then '4' when 'mistake' then '2' when 'inaccuracy' then '6' end, '') end as nags,
      case when judgement is not null and prev % 2 = 0 then 'e2e4' end as better,
      case when judgement is not null and prev % 2 = 0 then 'e2e4 e7e5' end as line,
      case when judgement is not null and prev % 2 = 0 then upper(substr(judgement, 1, 1)) || substr(judgement, 2) || '. Better was' end as note from an""",
)
def annotate(spark, d):
    e = evals(spark, d).withColumn("best", F.when(F.col("event_id") % 2 == 0, "e2e4").otherwise("d2d4"))
    e = e.withColumn("pv", F.array("best", F.lit("e7e5")))
    old = F.when(F.col("event_id") % 3 == 0, "good [%eval 0.99]").when(F.col("event_id") % 3 == 1, "so [%eval #2] so").otherwise(" [%eval 1.0] ")
    rows = e.filter(F.col("ply") >= 1).select(
        "game_id", "ply", F.lit("d2d4").alias("uci"), old.alias("comment"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit(7), F.lit(3))).alias("nags"),
    )
    out = J.annotate(rows, e, ["game_id"])
    return out.select(
        "game_id", "ply", "comment", F.array_join("nags", ",").alias("nags"), "better",
        F.array_join("better_line", " ").alias("line"), F.col("better_comment").alias("note"),
    )


@check(
    "win_06_terminal",
    f"""with {V.CHESS}, ply as (select id, unnest(range(0, cast(m + 1 as bigint))) as ply, line from c)
    select id, cast(ply as int) as ply, cast(case when line = 7 and ply = 4 then -1 else ply * 10 end as int) as cp,
      cast(case when line = 7 and ply = 4 then 0 end as int) as mate from ply""",
)
def terminal(spark, d):
    from checks.sequences import played
    from ludograph.operators.replay import plies

    rows = plies(played(spark, d), "id", "tokens")
    into = rows.select("id", (F.col("ply") + 1).alias("ply"), F.col("san").alias("into"))
    e = rows.join(into, ["id", "ply"], "left").withColumn("cp", (F.col("ply") * 10).cast("int")).withColumn("mate", F.lit(None).cast("int"))
    return J.terminal_scores(e, F.coalesce(F.col("into").rlike("#$"), F.lit(False))).select("id", "ply", "cp", "mate")


@check(
    "win_07_coverage",
    f"""with {V.P} select game_id, cast(count(*) as bigint) as total, cast(sum(case when event_id % 3 <> 0 then 1 else 0 end) as bigint) as done from steps group by game_id""",
)
def coverage(spark, d):
    rows = V.steps(spark, d)
    return J.coverage(rows, rows.filter(F.col("event_id") % 3 != 0), ["game_id"])


def log_lines(spark, d):
    """Engine output per user day, written from its events: complete, bound and pointless lines."""
    e = V.events(spark, d)
    n = F.col("event_id")
    score = F.when(n % 6 == 0, F.concat(F.lit("mate "), (n % 9 - 4).cast("string"))).otherwise(
        F.concat(F.lit("cp "), (F.col("cents") - 5000).cast("string"))
    )
    bound = F.when(n % 7 == 0, " lowerbound").when(n % 7 == 1, " upperbound").otherwise("")
    moves = F.when(n % 13 == 0, "").otherwise(F.concat(F.lit(" pv e2e4 "), F.lit("e7e5 g1f3")))
    line = F.concat(
        F.lit("info depth "), (n % 30).cast("string"), F.lit(" seldepth 9"), F.when(n % 2 == 0, " multipv 2").otherwise(""),
        F.lit(" score "), score, bound, F.lit(" nodes 10 nps 5"), moves,
    )
    line = F.when(n % 10 == 3, "info string score cp 9 pv a2a3").when(n % 10 == 7, "bestmove e2e4").otherwise(line)
    return e.select("game_id", F.col("event_id").alias("seq"), F.when(F.col("game_id") % 2 == 0, "b").otherwise("w").alias("turn"), line.alias("line"))


@check(
    "src_07_engine_log",
    f"""with {V.EV}, ok as (select game_id, event_id as seq, case when event_id % 2 = 0 then 2 else 1 end as multipv, cast(event_id % 30 as int) as depth,
      case when game_id % 2 = 0 then -1 else 1 end as sgn, event_id, cents from ev
      where event_id % 10 not in (3, 7) and event_id % 7 not in (0, 1) and event_id % 13 <> 0),
    last as (select *, row_number() over (partition by game_id, multipv order by seq desc) as rn from ok)
    select game_id, multipv, depth, cast(case when event_id % 6 <> 0 then sgn * (cents - 5000) end as int) as cp,
      cast(case when event_id % 6 = 0 then sgn * (event_id % 9 - 4) end as int) as mate, 'e2e4' as best, 'e2e4 e7e5 g1f3' as pv from last where rn = 1""",
)
def engine_log(spark, d):
    out = parse_engine_log(log_lines(spark, d), ["game_id"])
    return out.withColumn("pv", F.array_join("pv", " "))
