"""The stored tables: versions of plain Parquet folders, additions, replacements, deletions.

Layout: each change writes folders of its own, ``path/games/t=<tag>``, ``path/positions/t=<tag>`` ..., and is then
committed by a file ``path/commits/<version>.json`` that names them. That file is created only if there is none yet, so of
two writers that work on the same version one commits; the other looks at what the first did and tries again. A
failed job leaves folders that no commit names, and changes nothing that readers see.

An addition writes new rows only; a deletion writes the ids that are gone, a replacement ids and new rows; both hide rows
of earlier versions. ``sizes`` holds the number of state rows of each game, so a deletion is counted without reading the
index, and ``files`` the least and greatest key of each data file, so that lookups open the files that can hold the key.
``compact`` writes what is left as a new base, from which readers start, and ``vacuum`` removes the folders before it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.operators.explorer import explore_all
from ludograph.operators.sequences import horizon as cut_horizon
from ludograph.plans.explorer_table import ExplorerTable

META = "version bigint, base bigint, horizon int, games bigint, positions bigint, batch bigint"
# top: largest id so far; kind: what the version holds: rows, marks or both
STORED = f"{META}, top bigint, kind string, tag string"
ATTEMPTS = 20
NO_DATE = -1  # stands for a missing date in the order of games
STALE = 24 * 3600 * 1000  # folders without a commit are left alone for so long (ms)


@dataclass(frozen=True)
class Tables:
    games: DataFrame
    positions: DataFrame


# ---- changes, as frames ------------------------------------------------------------------


def add_games(tables: Tables, games: DataFrame, positions: DataFrame, n: int | None = None) -> Tables:
    """Add records as they are (no duplicate check); states beyond the horizon ``n`` stay out."""
    rows = positions if n is None else cut_horizon(positions, n)
    return Tables(tables.games.unionByName(games), merge_positions(tables.positions, rows))


def delete_games(tables: Tables, ids: DataFrame, key: str = "id") -> Tables:
    """Drop games and their state rows; nothing is replayed."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    games = tables.games.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    positions = tables.positions.join(gone, F.col("game_id") == F.col("_gone"), "left_anti")
    return Tables(games, positions)


def unknown_ids(tables: Tables, ids: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).join(tables.games.select(key), key, "left_anti")


def replace_games(tables: Tables, games: DataFrame, positions: DataFrame, key: str = "id") -> Tables:
    """Swap records, keeping their ids. An id that is not stored is an error."""
    if unknown_ids(tables, games, key).limit(1).count():
        raise ValueError("a game to replace is not stored")
    rest = delete_games(tables, games, key)
    return Tables(rest.games.unionByName(games), rest.positions.unionByName(positions))


def merge_positions(index: DataFrame, new: DataFrame) -> DataFrame:
    """Add state rows whose (hash, move, game) is not in the index yet.

    A start state's key is shared by every game, but the join key includes the game, so it spreads. The index is cut to
    the games of the new rows first, by a join that is broadcast where they are few.
    """
    keys = ["hash", "move", "game_id"]
    fresh = new.dropDuplicates(keys)
    held = index.select(*keys).join(new.select("game_id").distinct(), "game_id", "left_semi")
    fresh = fresh.join(held, keys, "left_anti")
    return index.unionByName(fresh)


def counts(tables: Tables, version: int = 0, n: int = 60, batch: int | None = None, base: int = 0) -> DataFrame:
    """The meta row of a state of the tables: recomputed, never kept by hand."""
    spark = tables.games.sparkSession
    return spark.sql(
        """select cast({version} as bigint) as version, cast({base} as bigint) as base, cast({n} as int) as horizon,
                  (select count(*) from {g}) as games, (select count(*) from {p}) as positions,
                  cast({batch} as bigint) as batch""",
        version=version, base=base, n=n, batch=-1 if batch is None else batch, g=tables.games, p=tables.positions,
    )


def touch(meta: DataFrame, tables: Tables) -> DataFrame:
    """The meta row after a change: next version, fresh counts."""
    last = meta.agg(F.max("version").alias("v"), F.max("horizon").alias("h")).first()
    return counts(tables, (last["v"] or 0) + 1, last["h"] or 60)


# ---- stored tables ------------------------------------------------------------------------


def clustered(positions: DataFrame) -> DataFrame:
    """Ranged and sorted by the full key: a state is a short file range, a hot one spans many files."""
    keys = ["hash", "move", "game_id"]
    return positions.repartitionByRange(*keys).sortWithinPartitions(*keys)


def by_date(games: DataFrame) -> DataFrame:
    """Games in date order, so date filters skip row groups."""
    return games.repartitionByRange("date", "id").sortWithinPartitions("date", "id")


class Store:
    """Tables under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Commits.

    def _files(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def meta(self) -> DataFrame:
        """One row per version."""
        files, folder = self._files("commits")
        if not files.exists(folder):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).json(f"{self.path}/commits").where("version is not null")

    def _commits(self) -> list:
        return self.meta().orderBy("version").collect()

    def current(self):
        return self.meta().orderBy(F.desc("version")).first()

    def has_batch(self, batch: int) -> bool:
        return self.meta().filter(F.col("batch") == batch).limit(1).count() > 0

    def _commit(self, row: dict) -> bool:
        """Make a version visible; False if another writer has taken its number."""
        files, place = self._files("commits", f"{row['version']:012d}.json")
        try:
            out = files.create(place, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        return True

    def _change(self, work: Callable[[object], dict], n: int | None = None) -> int:
        """Work out a change of the current version and commit it; if another writer was first, do so again."""
        for attempt in range(ATTEMPTS):
            last = self.current()
            if last is not None and n is not None and n != last["horizon"]:
                raise ValueError(f"the state index holds plies 0..{last['horizon']}; its horizon is fixed")
            row = {"version": 1, "base": 1, "horizon": 60 if n is None else n, "games": 0, "positions": 0, "top": 0}
            if last is not None:
                row = {k: last[k] for k in row} | {"version": last["version"] + 1}
            row = row | {"batch": -1, "kind": "rows"} | work(last)
            if row["batch"] >= 0 and self.has_batch(row["batch"]):
                return self.meta().where(F.col("batch") == row["batch"]).first()["version"]
            if self._commit(row):
                return row["version"]
            time.sleep(0.05 * attempt)
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    # Folders.

    def _folders(self, name: str, tags: list[str]) -> DataFrame:
        paths = [f"{self.path}/{name}/t={t}" for t in tags]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _span(self, last) -> list:
        return [r for r in self._commits() if last["base"] <= r["version"] <= last["version"]]

    def _left(self, rows: DataFrame, key: str, span: list) -> DataFrame:
        """Rows (with the tag ``t`` of their folder) that no later version hides."""
        marked = [r for r in span if r["kind"] != "rows"]
        if not marked:
            return rows.drop("t")
        number = F.create_map(*[F.lit(x) for r in span for x in (r["tag"], r["version"])])
        gone = self._folders("deleted", [r["tag"] for r in marked])
        gone = gone.groupBy(F.col("id").alias("_gone")).agg(F.max(number[F.col("t")]).alias("_at"))
        later = (F.col(key) == F.col("_gone")) & (number[F.col("t")] < F.col("_at"))
        return rows.join(gone, later, "left_anti").drop("t")

    def _table(self, name: str, last) -> DataFrame:
        span = self._span(last)
        rows = self._folders(name, [r["tag"] for r in span if r["kind"] != "marks"])
        return self._left(rows, "id" if name in ("games", "sizes") else "game_id", span)

    def read(self) -> Tables:
        last = self.current()
        if last is None:
            raise ValueError("nothing is stored yet")
        return Tables(self._table("games", last), self._table("positions", last))

    def table(self, name: str) -> DataFrame:
        return self._table(name, self.current())

    def _write(self, tables: Tables, tag: str) -> dict:
        """Write rows under a tag, with the sizes of games and the keys of files; returns what a commit must say."""
        at = {name: f"{self.path}/{name}/t={tag}" for name in ("games", "positions", "sizes")}
        by_date(tables.games).write.parquet(at["games"])
        clustered(tables.positions).write.parquet(at["positions"])
        rows = self._folders("positions", [tag]).groupBy(F.col("game_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
        sizes = self._folders("games", [tag]).select("id").join(rows, "id", "left").select("id", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))
        sizes.repartitionByRange("id").sortWithinPartitions("id").write.parquet(at["sizes"])
        date = F.coalesce("date", F.lit(NO_DATE))
        for name, keys in (("games", {"id": F.col("id"), "date": date}), ("positions", {"hash": F.col("hash"), "game_id": F.col("game_id")})):
            stats = [f(c).alias(f"{w}_{k}") for k, c in keys.items() for f, w in ((F.min, "least"), (F.max, "most"))]
            held = self.spark.read.parquet(at[name]).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), *stats)
            held.coalesce(1).write.parquet(f"{self.path}/files/{name}/t={tag}")
        games, positions = (self._folders(f"files/{name}", [tag]) for name in ("games", "positions"))
        counted = games.agg(F.sum("n").alias("n"), F.max("most_id").alias("top")).first()
        return {"games": counted["n"] or 0, "positions": positions.agg(F.sum("n")).first()[0] or 0, "top": counted["top"] or 0, "tag": tag}

    def _mark(self, ids: DataFrame, key: str, tag: str) -> tuple[int, int]:
        """Write the stored ones of the ids as gone; returns how many games and positions they have. Of the stored
        tables only the sizes are read."""
        gone = ids.select(F.col(key).alias("id")).distinct()
        hit = self.table("sizes").join(gone, "id", "left_semi")
        hit.write.parquet(f"{self.path}/deleted/t={tag}")
        marks = self._folders("deleted", [tag]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        return marks["n"], marks["rows"]

    # Changes.

    def append(self, new: Tables, n: int | None = None, batch: int | None = None) -> int:
        """Store additional rows; nothing stored before is read or rewritten. A batch that is stored already is not stored
        again."""
        wrote: dict = {}

        def work(last) -> dict:
            wrote.update(wrote or self._write(new, uuid.uuid4().hex))
            more = wrote | {"batch": -1 if batch is None else batch}
            if last is None:
                return more
            return more | {k: wrote[k] + last[k] for k in ("games", "positions")} | {"top": max(wrote["top"], last["top"])}

        return self._change(work, n)

    def delete(self, ids: DataFrame, key: str = "id") -> int:
        """Hide games and their state rows. Ids that are not stored are ignored."""
        def work(last) -> dict:
            tag = uuid.uuid4().hex
            games, positions = self._mark(ids, key, tag)
            return {"games": last["games"] - games, "positions": last["positions"] - positions, "kind": "marks", "tag": tag}

        return self._change(work)

    def replace(self, new: Tables, key: str = "id") -> int:
        """Swap records, keeping their ids. An id that is not stored is an error."""
        def work(last) -> dict:
            if not new.games.select(key).join(self.table("sizes").select(F.col("id").alias(key)), key, "left_anti").isEmpty():
                raise ValueError("a game to replace is not stored")
            tag = uuid.uuid4().hex
            games, positions = self._mark(new.games, key, tag)
            wrote = self._write(new, tag)
            return wrote | {"games": last["games"] - games + wrote["games"], "positions": last["positions"] - positions + wrote["positions"],
                            "top": max(wrote["top"], last["top"]), "kind": "both"}

        return self._change(work)

    def rewrite(self, tables: Tables, n: int | None = None) -> int:
        """Store a changed state of the tables as the new base. If another writer was first, this raises: the state was
        worked out from what is no longer current."""
        start = self.current()

        def work(last) -> dict:
            if (last and last["version"]) != (start and start["version"]):
                raise RuntimeError("another writer has changed the tables")
            wrote = self._write(tables, uuid.uuid4().hex)
            return wrote | {"base": 1 if last is None else last["version"] + 1, "top": max(wrote["top"], last["top"] if last else 0)}

        return self._change(work, n)

    def compact(self) -> int:
        """Write what is left of all versions as one base: lookups open the files of one version again."""
        return self.rewrite(self.read())

    def vacuum(self) -> None:
        """Remove the folders of versions before the current base, and those of failed writers after a day. Jobs that still
        read them must have ended."""
        base, commits = self.current()["base"], self._commits()
        known = {r["tag"]: r["version"] for r in commits}
        now = time.time() * 1000
        for name in ("games", "positions", "sizes", "deleted", "files/games", "files/positions"):
            files, root = self._files(name)
            for found in files.listStatus(root) if files.exists(root) else []:
                tag = found.getPath().getName().removeprefix("t=")
                if known.get(tag, base) < base or (tag not in known and now - found.getModificationTime() > STALE):
                    files.delete(found.getPath(), True)
        files, root = self._files("explorer")
        for found in files.listStatus(root) if files.exists(root) else []:
            if int(found.getPath().getName().removeprefix("v=")) < base:
                files.delete(found.getPath(), True)

    # Lookups by the keys of files.

    def files(self, name: str) -> DataFrame:
        """The data files of the current version: ``file``, ``n`` rows, least and greatest keys."""
        span = self._span(self.current())
        return self._folders(f"files/{name}", [r["tag"] for r in span if r["kind"] != "marks"])

    def _of_files(self, name: str, found: DataFrame) -> DataFrame:
        span, paths = self._span(self.current()), [r["file"] for r in found.select("file").collect()]
        if not paths:
            return self.table(name).limit(0)
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
        return self._left(rows, "id" if name == "games" else "game_id", span)

    def state(self, hash_: object) -> DataFrame:
        """The index rows of one state, from the files that can hold it."""
        h = F.lit(hash_)
        return self._of_files("positions", self.files("positions").where((F.col("least_hash") <= h) & (F.col("most_hash") >= h))).where(F.col("hash") == h)

    def after(self, date: int | None, game: int, n: int = 1000) -> DataFrame:
        """The next ``n`` games in order of (date, id) behind a place; games without a date come first, so (None, 0) begins
        at the start. Files are taken in order of their least date until those rows that no other file can come before
        are enough."""
        key, place = F.coalesce("date", F.lit(NO_DATE)), F.lit(NO_DATE if date is None else date)
        held = self.files("games").where(F.col("most_date") >= place).orderBy("least_date", "file")
        behind = (key > place) | ((key == place) & (F.col("id") > game))
        take, count = 0, 0
        while True:
            listed = held.select("file", "n", "least_date").limit(2 * take + 8).collect()
            while take < len(listed) - 1 and count < n:
                count += listed[take]["n"]
                take += 1
            last = len(listed) < 2 * take + 8 and take >= len(listed) - 1  # there are no more files
            opened = listed if last else listed[: take]
            found = self._of_files("games", self.spark.createDataFrame([(r["file"],) for r in opened], "file string")).where(behind)
            if last or found.where(key < listed[take]["least_date"]).limit(n).count() >= n:
                return found.orderBy(key, "id").limit(n)
            count = 0  # rows before the place, or hidden ones: look into as many again

    # The explorer table: all states at once, tagged with the version it was built from.

    def materialise_explorer(self) -> DataFrame:
        version = self.current()["version"]
        table = ExplorerTable(self.spark, f"{self.path}/explorer/v={version}")
        return table.write(explore_all(self.read().positions)).read()

    def explorer_table(self) -> ExplorerTable:
        """The pre-computed table if it is of the current version, else rebuilt."""
        version = self.current()["version"]
        files, done = self._files("explorer", f"v={version}", "keys", "_SUCCESS")
        if not files.exists(done):
            self.materialise_explorer()
        return ExplorerTable(self.spark, f"{self.path}/explorer/v={version}")

    def explorer(self) -> DataFrame:
        return self.explorer_table().read()
