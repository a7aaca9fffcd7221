"""Engine scores: winning chances, score text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ludograph.functions.columns import col

LOGISTIC_SLOPE = 0.00368208  # fixed value
CP_CLAMP = 1000  # fixed value
# Smallest drop in winning chance and annotation code per judgement.
JUDGEMENTS = {"blunder": (0.6, 4), "mistake": (0.4, 2), "inaccuracy": (0.2, 6)}


def winning_chance(cp: Column | str, mate: Column | str) -> Column:
    """White's winning chance in [-1, 1]. A mate of 0 means already mated; cp has the winner's sign."""
    centi = F.coalesce(col(cp).cast("double"), F.lit(0.0))
    clamped = F.greatest(F.lit(-float(CP_CLAMP)), F.least(F.lit(float(CP_CLAMP)), centi))
    logistic = 2 / (1 + F.exp(-LOGISTIC_SLOPE * clamped)) - 1
    return (
        F.when(col(mate) == 0, F.signum(centi))
        .when(col(mate).isNotNull(), F.signum(col(mate).cast("double")))
        .otherwise(logistic)
    )


def judgement(drop: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (least, _) in sorted(JUDGEMENTS.items(), key=lambda kv: kv[1][0]):
        out = F.when(drop >= least, name).otherwise(out)
    return out


def _pawns(cp: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(cp.cast("double"), F.lit(0.0)) / 100)


def score_text(cp: Column | str, mate: Column | str) -> Column:
    """``+0.34``, ``-1.20``, ``#-3``, ``#``."""
    m = col(mate)
    signed = F.concat(F.when(col(cp) > 0, "+").otherwise(""), _pawns(col(cp)))
    return F.when(m == 0, "#").when(m.isNotNull(), F.concat(F.lit("#"), m.cast("string"))).otherwise(signed)


def eval_text(cp: Column | str, mate: Column | str) -> Column:
    """Text for an ``[%eval ...]`` command; empty when already mated."""
    m = col(mate)
    return F.when(m == 0, "").when(m.isNotNull(), F.concat(F.lit("#"), m.cast("string"))).otherwise(
        _pawns(col(cp))
    )
