"""State jobs: what an import does with the steps of its records.

A job names the words that are steps, says which records it cannot use, and turns games into state rows. The import
(``plans.ingest``) knows nothing else of the steps, so any sequence of named steps can be taken in. ``StepCounts`` is
the usual job: native running counts over step rows. ``replay.BoardStates`` is another, for written chess moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.functions import text as X
from ludograph.functions.hashing import text_key
from ludograph.operators.openings import build_openings
from ludograph.operators.sequences import states

END = "END"
PIECE = 1024  # steps of one record that are counted together


class StateJob(Protocol):
    carried: tuple[str, ...]  # columns that ``play`` adds for ``state_rows``

    def tokens(self, main: Column) -> Column:
        """The steps in a record's main-line text."""

    def reason(self, tags: Column, start: Column, n: Column) -> Column:
        """Why a record is not usable, else NULL."""

    def play(self, games: DataFrame) -> DataFrame:
        """Rows with tokens and start_state, which keep their columns and gain ``moves``, ``start_text``, ``warning``,
        ``error`` and those ``carried``."""

    def state_rows(self, games: DataFrame, keep: Sequence[str], horizon: int, first: bool = True) -> DataFrame:
        """(keep..., ply, hash, move): states 0..horizon of each game, each at its first visit (or all visits), with the
        step taken from it or the end marker. The first of ``keep`` tells games apart."""


@dataclass(frozen=True)
class StepCounts:
    """States are the counts of each step so far, whatever the order: as text (``2|0|1``) over a ``vocabulary``, else as a
    sum of step keys. Steps are words; they become rows and are counted by windows over each record, cut into pieces of
    ``PIECE`` steps if it has more than ``min_rows``. Counts only grow, so no state comes twice in a record."""

    vocabulary: tuple[str, ...] | None = None
    min_rows: int = 1_000_000
    carried = ()

    def tokens(self, main: Column) -> Column:
        return X.words_of(main)

    def reason(self, tags: Column, start: Column, n: Column) -> Column:
        return F.when((F.size(tags) == 0) & (n == 0), "not a record: no tags and no steps")

    def play(self, games: DataFrame) -> DataFrame:
        text = F.lit(None).cast("string")
        known = F.col("tokens")
        stop = F.lit(None).cast("bigint")
        if self.vocabulary is not None:  # a step that no state can hold ends the record there
            other = F.transform("tokens", lambda t: ~t.isin(*self.vocabulary))
            stop = F.array_position(other, F.lit(True)).cast("bigint")
            known = F.when(stop > 0, F.slice("tokens", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("tokens"))
        told = F.concat(F.lit('unknown step "'), F.get("tokens", (stop - 1).cast("int")), F.lit('" at ply '), stop.cast("string"))
        return games.select("*", known.alias("moves"), F.col("start_state").alias("start_text"),
                            F.when(stop > 0, told).alias("warning") if self.vocabulary is not None else text.alias("warning"),
                            text.alias("error"))

    def state_rows(self, games: DataFrame, keep: Sequence[str], horizon: int, first: bool = True) -> DataFrame:
        steps = F.concat(F.coalesce("moves", F.array().cast("array<string>")), F.array(F.lit(END)))
        rows = games.select(*keep, F.posexplode(F.slice(steps, 1, horizon + 1)).alias("at", "move"))
        bucket = F.floor(F.col("at") / PIECE)
        words = None if self.vocabulary is None else list(self.vocabulary)
        counted = states(rows, [keep[0]], ["at"], "move", vocabulary=words, bucket=bucket, min_rows=self.min_rows)
        return counted.select(*keep, F.col("ply").cast("int").alias("ply"), F.col("state").alias("hash"), "move")

    def state_of(self, steps: Sequence[str]) -> Column:
        """The state after some steps, as a constant: what a user who types a line looks up."""
        if self.vocabulary is not None:
            return F.lit("|".join(str(list(steps).count(w)) for w in self.vocabulary))
        return sum((text_key(F.lit(s), 9) for s in steps), F.lit(0).cast("bigint"))

    def named(self, lines: DataFrame) -> DataFrame:
        """Lines (eco, name, moves: words) -> the reference table of named states; the shortest line names a state."""
        words = lines.select("eco", "name", self.tokens(F.col("moves")).alias("moves"))
        rows = self.state_rows(words, ["name", "eco", "moves"], 400)
        last = rows.where(F.col("move") == END).select("eco", "name", "hash", F.col("ply").alias("plies"))
        return build_openings(last)
