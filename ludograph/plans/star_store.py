"""A stored star schema: imports add to it, names keep their ids, and searches run on it.

Beside the tables of ``Store`` there are, all append-only and named by the same commits: the dictionaries ``players``,
``events``, ``sites`` and ``openings`` (each version adds the names that were not there), the records that an import
rejected with their place and text, and one report per import. Games hold ids only. A load is worked out from the current
version and committed as a whole; if another writer commits first, it is worked out again, so ids are never given
twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.operators.dims import names_of, new_names, resolve_dims
from ludograph.operators.jobs import StateJob, StepCounts
from ludograph.operators.reports import history, ingest_report
from ludograph.operators.search import GameQuery, search_star
from ludograph.plans.ingest import Options, ingest, rejected
from ludograph.plans.star import Star
from ludograph.plans.tables import Store, Tables

# dictionary -> the name columns it serves, what it keeps beside the name, and whether case is ignored
DICTIONARIES = {
    "players": (["white", "black"], (), True), "events": (["event"], (), True), "sites": (["site"], (), True),
    "openings": (["opening"], ("eco",), False),
}
REJECTS = "batch bigint, seq bigint, file string, line bigint, message string, raw string"
REPORT = "batch bigint, imported bigint, duplicates bigint, errors bigint, warnings bigint, samples array<string>"


class StarStore(Store):
    def _all(self, name: str, schema: str, last=None) -> DataFrame:
        """An append-only table: what all versions up to the current one (or ``last``) have added."""
        last = last or self.current()
        files, folder = self._files(name)
        held = [r["tag"] for r in self._commits() if last and r["version"] <= last["version"]]
        held = [t for t in held if files.exists(self._files(name, f"t={t}")[1])]
        return self._folders(name, held).drop("t") if held else self.spark.createDataFrame([], schema)

    def names(self, dictionary: str, last=None) -> DataFrame:
        extra = "".join(f", {c} string" for c in DICTIONARIES[dictionary][1])
        return self._all(f"names/{dictionary}", f"id bigint, name string{extra}", last)

    def rejects(self) -> DataFrame:
        """Records that were not taken in: batch, place, reason and text."""
        return self._all("rejects", REJECTS)

    def reports(self, k: int = 50) -> DataFrame:
        """One row per import, the newest first."""
        return history(self._all("reports", f"version bigint, {REPORT}"), "version", k)

    def star(self) -> Star:
        return Star(self.table("games"), *[self.names(d) for d in DICTIONARIES])

    def load(self, records: DataFrame, openings: DataFrame | None = None, options: Options = Options(), *,
             states: StateJob = StepCounts(), batch: int | None = None) -> int:
        """Import records and commit them with their names, rejects and report. Returns the version."""
        def work(last) -> dict:
            tag = uuid.uuid4().hex
            stored = None if last is None else self._table("games", last).select("fingerprint")
            top = 0 if last is None else last["top"]
            number = (0 if last is None else last["version"]) if batch is None else batch
            done = ingest(records, openings, options, states=states, stored=stored, first_id=top + 1, batch=number)
            games = done.games.withColumnRenamed("ply_count", "plies")
            known = {}
            for name, (columns, extra, fold) in DICTIONARIES.items():
                before = self.names(name, last) if last is not None else self.spark.createDataFrame([], "id bigint, name string")
                seen = names_of(games, columns, "id") if not extra else games.select(
                    F.col(columns[0]).alias("name"), F.col("opening_eco").alias("eco"), F.col("id").alias("seq"))
                new_names(before, seen, extra=extra, fold=fold).write.parquet(f"{self.path}/names/{name}/t={tag}")
                known[name] = before.select("id", "name").unionByName(self._folders(f"names/{name}", [tag]).select("id", "name"))
            facts = resolve_dims(games, [
                ("white", known["players"], "white_id"), ("black", known["players"], "black_id"), ("event", known["events"], "event_id"),
                ("site", known["sites"], "site_id"),
            ])
            named = known["openings"].select(F.col("name").alias("opening"), F.col("id").alias("opening_id"))
            facts = facts.join(named, "opening", "left").drop("opening", "opening_eco")
            wrote = self._write(Tables(facts, done.positions), tag)
            rejected(done.statuses, records).select("batch", "seq", "file", F.col("line").cast("bigint").alias("line"), "message", "raw").write.parquet(
                f"{self.path}/rejects/t={tag}")
            version = 1 if last is None else last["version"] + 1
            ingest_report(done.statuses).select(F.lit(version).cast("bigint").alias("version"), "*").write.parquet(f"{self.path}/reports/t={tag}")
            more = wrote | {"batch": -1 if batch is None else batch, "top": max(wrote["top"], top)}
            return more if last is None else more | {k: wrote[k] + last[k] for k in ("games", "positions")}

        if batch is not None and self.has_batch(batch):
            return self.meta().where(F.col("batch") == batch).first()["version"]
        return self._change(work, options.horizon)

    def search(self, q: GameQuery) -> DataFrame:
        """A page of display rows."""
        return search_star(self.star(), q, self.state(q.state) if q.state is not None else None)
