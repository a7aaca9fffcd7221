"""Record files -> one row per record, in file order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ludograph.functions import text as X
from ludograph.functions.columns import col, let
from ludograph.operators.skew import running
from ludograph.session import ship, staged

MARK = "\n[Event "
MAX_FILE = 256 << 20

# One record as the fast way should cut it: tag lines (with blank, comment and escape lines between), then movetext whose
# comments are closed and whose lines outside comments begin with no bracket. All loops are possessive, so that
# long records take linear time and no stack.
_TAGS = r"(?:\[(?:[^\]\"\n]++|\"(?:[^\"\\\n]++|\\[^\n])*+\")*+\][^\S\n]*+)++"
_PASSED = r"[^\S\n]*+(?:[%;][^\n]*+)?+\n"
_PLAIN_RECORD = (
    rf"\A(?:{_PASSED})*+[ \t]*+{_TAGS}(?:;[^\n]*+)?+\n(?:{_PASSED}|[ \t]*+{_TAGS}(?:;[^\n]*+)?+\n)*+"
    r"[^\S\n]*+(?=[^\s\[%;])(?:[^{;\n]++|\{[^}]*+\}|;[^\n]*+|\n[ \t]*+(?:%[^\n]*+|(?!\[)))++\z"
)


def decode_text(c: Column | str) -> Column:
    """Bytes -> text: UTF-8 when valid, else Windows-1252; byte order mark and CR removed."""
    raw = col(c)
    return _plain(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(_western(raw)))


def _western(raw: Column) -> Column:
    # 0x80-0x9F differ between Latin-1 (always available) and Windows-1252.
    latin = F.decode(raw, "ISO-8859-1")
    code = bytes(range(0x80, 0xA0))
    low = "".join(chr(b) for b in code)
    high = code.decode("windows-1252", errors="replace")
    pairs = [(a, b) for a, b in zip(low, high) if b != "�"]
    return F.translate(latin, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def read_records(
    spark: SparkSession, paths: str | list[str], strict: bool | None = None, max_file: int = MAX_FILE, by_file: bool = False
) -> DataFrame:
    """(file, block, line, raw): one row per record, ordered by the first three.

    The fast way cuts at ``[Event `` lines while reading, so one large file is split over many tasks.
    It is right where Event is the first tag and stands in no comment, as in almost all files. ``strict``
    reads lines and cuts where a tag line follows movetext outside comments. There every file is worked on by
    its splits, joined up by what is known behind each (``max_file`` is of no account any more). By default all files
    are looked through the fast way first, and those with a record that it may have cut wrongly are read strictly.
    A tag section without movetext belongs to the record of the next one.

    Records that are not valid UTF-8 are taken as Windows-1252; with ``by_file`` all records of a file that is not
    valid UTF-8 are, and lines end at line feeds only, as where a file is decoded as a whole. That looks through the
    files once more, and suits a list of some hundreds of files.
    """
    western = _not_utf8(spark, paths) if by_file else None
    if strict:
        return _read_strict(spark, paths, max_file, western=western)
    fast = _read_fast(spark, paths, western)
    if strict is False:
        return fast
    # There may be many: their names are written, not brought to the driver.
    odd = staged(needs_strict(fast))
    if odd.isEmpty():
        return fast
    return fast.join(odd, "file", "left_anti").unionByName(_read_strict(spark, paths, max_file, odd, western))


def _not_utf8(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Names of the files that are not valid UTF-8. No character holds a line feed, so lines tell."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return staged(lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("file")).distinct())


def _decoded(rows: DataFrame, western: DataFrame | None) -> DataFrame:
    """Rows with a text ``value`` as read -> as text; ``western`` names the files in Windows-1252, if files are judged."""
    raw = F.col("value").cast("binary")
    if western is None:
        return rows.withColumn("value", decode_text(raw))
    rows = rows.join(F.broadcast(western.withColumn("_western", F.lit(True))), "file", "left")
    return rows.withColumn("value", _plain(F.when(F.col("_western"), _western(raw)).otherwise(F.col("value")))).drop("_western")


def _read_fast(spark: SparkSession, paths: str | list[str], western: DataFrame | None = None) -> DataFrame:
    rows = spark.read.option("lineSep", MARK).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )

    def judged(raw: Column) -> Column:
        # The separator is eaten: every record but the first of a file (which has its own) gets it back.
        whole = F.when(raw.rlike('^[ \t]*"'), F.concat(F.lit(MARK[1:]), raw)).otherwise(raw)
        head = F.ltrim(F.substr(raw, F.lit(1), F.lit(200)), F.lit(" \t\r\n"))
        # Blank text and escape lines in front of the first tag are no record.
        odd = head.startswith("%") | (head == "")
        empty = odd & ~F.regexp_replace(raw, X.ESCAPE_LINE, "").rlike(r"\S")
        return F.when(~empty, whole)

    rows = _decoded(rows, western).select("file", "block", "line", let(F.col("value"), judged).alias("raw"))
    return rows.filter(F.col("raw").isNotNull())


def _plain(c: Column) -> Column:
    """Without carriage returns and a leading byte order mark."""
    return let(
        F.replace(c, F.lit("\r"), F.lit("")),
        lambda t: F.when(t.startswith("\ufeff"), F.substr(t, F.lit(2))).otherwise(t),
    )


def numbered_records(records: DataFrame) -> DataFrame:
    """Add ``pos``: ascending numbers in order of path, split and line (gaps where lines were dropped).

    Lines count up within a split, so only each split's first and last line are needed: one small row
    per split (of 128 MB, say) is put in order in one place and joined back.
    """
    spans = records.groupBy("file", "block").agg(F.min("line").alias("_first"), F.max("line").alias("_last"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(earlier), F.lit(0))
    offsets = spans.select("file", "block", (before - F.col("_first") + 1).alias("_shift"))
    rows = records.join(offsets, ["file", "block"])
    return rows.withColumn("pos", (F.col("line") + F.col("_shift")).cast("bigint")).drop("_shift")


def _open_after(text: Column) -> Column:
    """Is a brace comment open behind a text that starts outside one?"""
    shown = F.regexp_replace(text, r"^((?:[^{};]|\{[^}]*+\}|\})*+);.*$", "$1")
    # Most lines have no brace.
    return F.when(text.contains("{"), F.regexp_replace(shown, r"\{[^}]*\}", "").contains("{")).otherwise(False)


def _line_facts(line: Column) -> dict[str, Column]:
    """What a line tells by itself. ``settled``: whether a comment is open behind it, NULL where that follows from before;
    ``tag``, ``behind``: a tag line outside comments, with text behind its tags; ``plain``: text outside comments."""
    from_outside = ~line.rlike(r"^[ \t]*[%\[]") & _open_after(line)
    from_inside = F.when(
        line.contains("}"), _open_after(F.substr(line, F.instr(line, "}") + 1))
    ).otherwise(True)
    behind = F.regexp_replace(line, r'^(?:[ \t]*\[(?:[^\]"]|"(?:[^"\\]|\\.)*+")*+\])++', "")
    tag = line.rlike(r"^[ \t]*\[")
    return {
        # Without a brace nothing is settled.
        "settled": F.when((line.contains("{") | line.contains("}")) & (from_outside == from_inside), from_inside),
        "tag": tag,
        "behind": tag & behind.rlike(r"^[ \t]*[^\s;]"),
        "plain": line.rlike(r"\S") & ~line.rlike(r"^[ \t]*[%;]"),
    }


def line_records(lines: DataFrame) -> DataFrame:
    """Number the record of every line: (file, block, line, value) -> + record (0.. per file).

    A record begins at a tag line outside comments when the nearest line before it that is neither
    blank nor a comment line ended in movetext. Whether a comment is open follows from the latest
    line that settles it. All of these are running values that share one shuffle by file.
    """

    def along(df: DataFrame, **what) -> DataFrame:
        return running(df, ["file"], ["block", "line"], **what)

    rows = lines.withColumn("value", _plain(F.col("value")))
    facts = _line_facts(F.col("value"))
    rows = along(rows, latest={"_in": facts["settled"]})
    inside = F.coalesce("_in", F.lit(False))
    tag = facts["tag"] & ~inside
    text = F.when(tag, facts["behind"]).otherwise(inside | facts["plain"])
    marked = rows.select("file", "block", "line", "value", tag.alias("tag"), text.alias("text"))
    said = F.when(F.col("tag") | F.col("text"), F.col("text"))
    marked = along(marked, latest={"_before": said})
    begins = (F.col("tag") & F.coalesce("_before", F.lit(False))).cast("bigint")
    counted = along(marked.select("file", "block", "line", "value", begins.alias("_begins")), sums={"record": F.col("_begins")})
    return counted.withColumn("record", F.col("record") + F.col("_begins")).drop("_begins")


class _Split:
    """The running values of ``line_records`` along the lines of one split, batch by batch. ``inside``: is a comment open
    so far; ``before``: did the latest line that says something end in movetext (None: no such line yet)."""

    def __init__(self, inside: bool, before: bool | None) -> None:
        self.inside, self.before = inside, before

    def begins(self, settled: np.ndarray, tag: np.ndarray, behind: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Which of the next lines begin a record."""
        inside, self.inside = _latest(settled, self.inside)
        inside = inside.astype(bool)
        tag = tag & ~inside
        text = np.where(tag, behind, inside | plain)
        before, last = _latest(np.where(tag | text, text, -1), -1 if self.before is None else self.before)
        self.inside, self.before = bool(self.inside), None if last < 0 else bool(last)
        return tag & (before == 1)


def _latest(values: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """Per row the last value before it that is not negative (``start`` if none), and the one behind all rows."""
    at = np.maximum.accumulate(np.concatenate([[0], np.where(values >= 0, np.arange(1, len(values) + 1), 0)]))
    known = np.concatenate([[start], values])[at]
    return known[:-1], int(known[-1])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch, list[np.ndarray]]]:
    """Runs of lines of one split: is the split new, its rows, their facts."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        ends = pc.run_end_encode(file).run_ends.to_numpy()
        cuts = np.unique(np.concatenate([[0], ends, np.flatnonzero(np.diff(block)) + 1]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = batch.slice(a, b - a)
            place = (file[a].as_py(), int(block[a]))
            facts = [rows.column("settled").to_numpy(), *(rows.column(n).to_numpy(zero_copy_only=False) for n in ("tag", "behind", "plain"))]
            yield place != last, rows, facts
            last = place


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The running values behind each split, for both values of ``inside`` in front of it; -1 for no ``before``."""
    out, runs, place = [], [], None

    def told() -> list:
        return [*place, *(x for r in runs for x in (r.inside, -1 if r.before is None else int(r.before)))]

    for new, rows, facts in _splits(batches):
        if new:
            if place:
                out.append(told())
            place, runs = (rows.column("file")[0].as_py(), rows.column("block")[0].as_py()), [_Split(False, None), _Split(True, None)]
        for r in runs:
            r.begins(*facts)
    if place:
        out.append(told())
    names = ["file", "block", "in_0", "before_0", "in_1", "before_1"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the values in front of their split -> records: (file, block, line, raw, begins, edge). What stands in
    front of a split's first beginning and behind its last are edges, which may go on in other splits."""
    split, held, at, starts, place = None, [], 0, False, None
    out: list[tuple] = []

    def close(edge: bool) -> None:
        if held:
            out.append((*place, at, "\n".join(held), starts, edge))

    def made() -> pa.RecordBatch:
        names = ["file", "block", "line", "raw", "begins", "edge"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        rows = list(zip(*out)) or [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    for new, rows, facts in _splits(batches):
        values, first = rows.column("value").to_pylist(), rows.column("line")[0].as_py()
        if new:
            close(True)
            before = rows.column("in_front")[0].as_py()
            split = _Split(rows.column("inside")[0].as_py(), None if before < 0 else bool(before))
            place, held, at, starts = (rows.column("file")[0].as_py(), rows.column("block")[0].as_py()), [], first, False
        done = 0
        for i in np.flatnonzero(split.begins(*facts)).tolist():
            held.extend(values[done:i])
            close(not starts)
            held, at, starts, done = [], first + i, True, i
        held.extend(values[done:])
        if out:
            yield made()
    close(True)
    yield made()


def _read_strict(
    spark: SparkSession, paths, max_file: int, only: DataFrame | None = None, western: DataFrame | None = None
) -> DataFrame:
    """``only``: names of the files to read (``file``), if not all.

    Lines are looked through twice where they are read and never shuffled: for the running values behind each split, which
    are few and joined up by file, and for the records. Only the records at the edges of splits travel.
    """
    ship(spark)
    reader = spark.read if western is None else spark.read.option("lineSep", "\n")
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    if only is not None:  # by a broadcast of names, since lines must stay in order
        lines = lines.join(F.broadcast(only), "file", "left_semi")
    lines = _decoded(lines, western).withColumn("value", _plain(F.col("value")))
    facts = _line_facts(F.col("value"))
    told = [F.coalesce(facts["settled"].cast("int"), F.lit(-1)).alias("settled"), *(F.coalesce(facts[n], F.lit(False)).alias(n) for n in ("tag", "behind", "plain"))]
    ends = lines.select("file", "block", *told).mapInArrow(_ends, "file string, block bigint, in_0 boolean, before_0 int, in_1 boolean, before_1 int")
    # Few rows, one for each split: the values are handed on from split to split of a file.
    spot = F.struct("block", "in_0", "before_0", "in_1", "before_1")
    front = F.struct(F.lit(False).alias("inside"), F.lit(-1).alias("in_front"))
    begun = F.struct(front.alias("now"), F.array().cast("array<struct<block:bigint,inside:boolean,in_front:int>>").alias("all"))

    def hand_on(a: Column, e: Column) -> Column:
        was = a["now"]
        said = F.when(was["inside"], e["before_1"]).otherwise(e["before_0"])
        now = F.struct(
            F.when(was["inside"], e["in_1"]).otherwise(e["in_0"]).alias("inside"), F.when(said >= 0, said).otherwise(was["in_front"]).alias("in_front"))
        own = F.struct(e["block"].alias("block"), was["inside"].alias("inside"), was["in_front"].alias("in_front"))
        return F.struct(now.alias("now"), F.concat(a["all"], F.array(own)).alias("all"))

    fronts = ends.groupBy("file").agg(F.array_sort(F.collect_list(spot)).alias("splits"))
    fronts = staged(fronts.select("file", F.inline(F.aggregate("splits", begun, hand_on, lambda a: a["all"]))))
    rows = lines.join(F.broadcast(fronts), ["file", "block"])
    rows = rows.select("file", "block", "line", "value", *told, "inside", "in_front")
    cut = rows.mapInArrow(_cut, "file string, block bigint, line bigint, raw string, begins boolean, edge boolean")
    out = ["file", "block", "line", "raw"]
    # The edges are cut in a reading of their own, where they are few, so no record is written.
    edges = cut.where("edge").select(*out, F.col("begins").cast("bigint").alias("_begins"))
    edges = running(edges, ["file"], ["block", "line"], sums={"record": F.col("_begins")})
    edges = edges.select("file", "block", "line", F.col("raw").alias("value"), (F.col("record") + F.col("_begins")).alias("record"))
    return cut.where("not edge").select(*out).where(F.col("raw").rlike(r"\S")).unionByName(group_lines(edges))


def group_lines(numbered: DataFrame) -> DataFrame:
    """Numbered lines -> records. A record's lines are few, so they may be gathered."""
    rows = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    records = numbered.groupBy("file", "record").agg(rows.alias("rows"))
    raw = F.array_join(F.transform("rows", lambda r: r["value"]), "\n")
    first = F.get("rows", F.lit(0))
    out = records.select("file", first["block"].alias("block"), first["line"].alias("line"), raw.alias("raw"))
    return out.filter(F.col("raw").rlike(r"\S"))


def needs_strict(records: DataFrame) -> DataFrame:
    """Files where the fast way is not safe: a record is not plainly tags and then movetext.

    It may have tags without movetext (more tags follow the cut), a line that begins with a bracket behind movetext
    (whatever its name and value), an open comment, or no tags in front.
    """
    return records.filter(~F.col("raw").rlike(_PLAIN_RECORD)).select("file").distinct()


def records_of_texts(texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Texts in a column (uploads, one per row) -> the same rows as ``read_records``."""
    lines = texts.select(
        F.col(name).cast("string").alias("file"), F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split(text, "\n")).alias("line", "value"),
    )
    # A text is one row, so its lines are bounded.
    return group_lines(line_records(lines.withColumn("line", F.col("line").cast("bigint"))))


def records_from_text(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A few texts in hand (a form, a message) -> records."""
    rows = [(f"text-{n:06d}", t) for n, t in enumerate(texts)]
    return records_of_texts(spark.createDataFrame(rows, "name string, text string"))


def list_records(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Label per record, without replaying it: ``White – Black result · event``."""
    rows = records.withColumn("_t", X.tags(raw))

    def tag(name: str) -> Column:
        value = F.element_at("_t", name)
        return F.when(~value.isin("?", ""), value)

    label = F.concat(
        F.coalesce(tag("White"), F.lit("?")), F.lit(" – "), F.coalesce(tag("Black"), F.lit("?")), F.lit(" "),
        F.coalesce(tag("Result"), F.lit("*")),
        F.coalesce(F.concat(F.lit(" · "), tag("Event")), F.lit("")),
    )
    return rows.withColumn("label", label).drop("_t")
