"""Personal data in texts: e-mail and IP addresses, payment card and phone numbers.

Method: candidate gradient boosting. Strict patterns give the base spans. Looser generators propose further spans, which
may overlap each other and base spans: parts of longer number groups, obfuscated or non-ASCII addresses, national phone
numbers. Boosted trees score each proposal by its format and its surroundings, and a threshold for each kind, calibrated
on held-out documents, selects those that are added. Base spans always stay.

The trees learn from base spans of documents outside the held-out fold: as they stand and in other spellings
(label 1), damaged so that the kind's own check fails (label 0), and from proposals that fail it (label 0). Surroundings are swapped
in a third of the rows. Every such span of every document counts, in training and in calibration: spans that are described alike
are one row with their number as its weight, so the trees see far fewer rows than there are spans. No label table is read.

Everything is columns: patterns, splitting for positions, higher-order functions, and the boosted trees of Spark's
own library; no Python runs in tasks. Patterns give up no steps on long texts: repeated groups are possessive, so they neither go back nor
nest calls. Each text is looked at where it stands; only spans and 24 characters around them travel.

Positions are code points; ends are exclusive. Null and empty texts have no spans. Every row gives a row, also for repeated or null
keys. An empty table, or one without base spans, gives a model that adds nothing. Only key and text are read, so other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludograph.llm.common import fold, staged

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
PRECISION = 0.99  # wanted of added spans, on held-out documents
LEFT, RIGHT = 24, 8
BLOCK = 256
LONG = "bigint"

# The strict patterns, each found from left to right without overlaps. Where they are written with possessive groups and
# a look behind, they match what the plain forms do, in linear time.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({](?:at|AT)[\])}] ?| ?@ ?)", r"(?: ?[\[({](?:dot|DOT)[\])}] ?|\.)"
_END = r"(?![0-9])"
# What a proposal begins behind, its text, and what may not follow.
GENERATORS = [
    (EMAIL, r"(?<![\p{L}\p{N}._%+-])", r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}", ""),
    (EMAIL, r"(?<![A-Za-z0-9._%+-])", rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", ""),
    (EMAIL, r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,8}", ""),
    (IP, r"(?<![0-9])", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", _END),
    (IP, r"(?<![0-9])", r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?[\[(]dot[\])] ?| dot )[0-9]{1,3}){3}", _END),
    (CARD, r"(?<![0-9])", r"[0-9]{13,19}", _END),
    (CARD, r"(?<![0-9])", r"[0-9]{4}(?:[ .-][0-9]{4}){3}", _END),
    (CARD, r"(?<![0-9])", r"3[0-9]{3}[ .-][0-9]{6}[ .-][0-9]{4,5}", _END),
    (PHONE, "", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}", _END),
    (PHONE, "", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2}", _END),
    (PHONE, r"(?<![0-9+.-])", r"(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}", _END),
]
# A text that fits none of a kind's has no span of it, base or proposed; looked up before the patterns are tried. All but
# the first need a digit.
MARKS = ["@", "at]", "at)", "at}", "AT]", "AT)", "AT}", " dot ", " DOT "]
GATES = {IP: r"[0-9](?:\.[0-9]|\[\.|\(\.| ?[\[(]dot| dot )", CARD: r"[0-9](?:[ .-]?[0-9]){12}", PHONE: r"\+[0-9]|[0-9][ .-][0-9]{4}"}
_WORDS = {
    EMAIL: "mail|contact|write", IP: r"\bip\b|host|server|addr", CARD: "card|visa|amex|carte|karte|tarjeta|pay",
    PHONE: "phone|tel|call|fax|mobil|fon",
}
TOP_LEVEL = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|nl|pl|ch|at|br|mx|in|cn|jp|ru"
SPAN = f"struct<start:{LONG},kind:int,end:{LONG},txt:string,left:string,right:string>"


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values, each worked out once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.reduce(numbers, F.lit(0).cast(LONG), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Sums of the first 1, 2, 3 ... numbers of an array that is not empty, by blocks."""
    def sums(x: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), (F.size(x["v"]) - 1).cast("int")),
            lambda i: total(F.slice(x["b"], F.lit(1), F.floor(i / BLOCK).cast("int")))
            + total(F.slice(x["v"], (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK + 1).cast("int"))),
        )
        return each

    def blocks(x: Column) -> Column:
        last = F.floor((F.size(x["v"]) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(x["v"], b * BLOCK + 1, F.lit(BLOCK))))

    return let(lambda x: let(sums, v=x["v"], b=blocks(x)), v=numbers)


def _before(piece: Column, i: Column, extra: int) -> Column:
    """The last characters of a piece; ``extra`` characters of the first one are not the text's own."""
    if not extra:
        return F.right(piece, F.lit(LEFT))
    return F.right(piece, F.when(i > 0, F.lit(LEFT)).otherwise(F.least(F.lit(LEFT), F.char_length(piece) - extra)))


def _spans(kind: int, hits: Column, pieces: Column, rights: Column | None, offset: int) -> Column:
    """Spans of a pattern's hits; piece i is the text before hit i. ``rights`` is what follows each hit where hits have no
    width in the pieces; else hits and pieces alternate and the next piece follows."""
    def steps(x: Column) -> Column:
        before = F.transform(x["h"], lambda _, i: F.char_length(F.get(x["p"], i)).cast(LONG))
        if rights is not None:
            return before
        earlier = F.concat(F.array(F.lit(0).cast(LONG)), F.transform(x["h"], lambda h: F.char_length(h).cast(LONG)))
        return let(lambda y: F.transform(y["b"], lambda n, i: n + F.get(y["e"], i)), b=before, e=earlier)

    def build(x: Column) -> Column:
        return F.transform(x["h"], lambda h, i: F.struct(
            (F.get(x["at"], i) + offset).alias("start"), F.lit(kind).alias("kind"),
            (F.get(x["at"], i) + offset + F.char_length(h)).alias("end"), h.alias("txt"),
            _before(F.get(x["p"], i), i, -offset).alias("left"),
            (F.left(F.get(x["p"], i + 1), F.lit(RIGHT)) if rights is None else F.get(x["r"], i)).alias("right"),
        ))

    values = {"h": hits, "p": pieces} | ({} if rights is None else {"r": rights})
    found = let(lambda x: F.when(F.size(x["h"]) > 0, let(build, at=running(steps(x)), **{k: x[k] for k in values})), **values)
    return F.coalesce(found.cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>"))


def digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def passes(kind: int, txt: Column) -> Column:
    """The check that a match of a kind's strict pattern must pass."""
    n = F.char_length(digits(txt))
    if kind == IP:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return txt.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == CARD:
        return n.between(14, 19) & luhn(digits(txt))
    return n.between(10, 15) if kind == PHONE else F.lit(True)


def _check(kind: int) -> Callable[[Column], Column]:
    return lambda s: passes(kind, s["txt"])


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column, gates: dict[int, Column]) -> Column:
    """The strict patterns' matches that pass their check."""
    found = []
    for kind, pattern in BASE.items():
        spans = _spans(kind, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), None, 0)
        found.append(F.when(gates[kind], F.filter(spans, _check(kind))).otherwise(_none()))
    return F.concat(*found)


def proposed_spans(text: Column, gates: dict[int, Column]) -> Column:
    """The generators' matches, overlapping ones included."""
    found = []
    shifted = F.concat(F.lit("\n"), text)  # hits have no width: none may lie at the very start
    for kind, behind, shape, end in GENERATORS:
        pattern = rf"{behind}(?=({shape}){end}((?s:.{{0,{RIGHT}}})))"
        hits, rights = (F.regexp_extract_all(shifted, F.lit(pattern), F.lit(g)) for g in (1, 2))
        spans = _spans(kind, hits, F.split(shifted, pattern, -1), rights, -1)
        found.append(F.when(gates[kind], spans).otherwise(_none()))
    return F.concat(*found)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a number of its own), ``key``, ``base`` and ``proposed`` spans of each text; stored."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast(LONG).alias("key"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    mark = F.contains("text", F.lit(MARKS[0]))
    for m in MARKS[1:]:
        mark = mark | F.contains("text", F.lit(m))
    rows = rows.select("*", mark.alias("gate_0"), F.col("text").rlike("[0-9]").alias("digit"))
    rows = rows.select("*", *[(F.col("digit") & F.col("text").rlike(g)).alias(f"gate_{k}") for k, g in GATES.items()])
    gates = {k: F.col(f"gate_{k}") for k in range(len(KINDS))}
    return staged(rows.select("row", "key", base_spans(F.col("text"), gates).alias("base"),
                              proposed_spans(F.col("text"), gates).alias("proposed")))


def plain_form(kind: Column, txt: Column) -> Column:
    """A span without the marks of other spellings."""
    email = F.regexp_replace(F.regexp_replace(txt, rf"{_AT}| (?:at|AT) ", "@"), rf"{_DOT}| (?:dot|DOT) ", ".")
    ip = F.regexp_replace(txt, r"\[\.\]|\(\.\)| ?[\[(]dot[\])] ?| dot ", ".")
    card = F.regexp_replace(txt, r"[ .-]", "")
    return F.when(kind == EMAIL, email).when(kind == IP, ip).when(kind == CARD, card).otherwise(txt)


def fits(kind: Column, txt: Column) -> Column:
    """Whether a span in its plain form passes its kind's check."""
    plain = plain_form(kind, txt)
    words = ~F.contains(txt, F.lit("@")) & ~txt.rlike(r"[\[({]")  # "at" and "dot" are also plain words
    email = (~words | plain.rlike(rf"(?i)\.(?:{TOP_LEVEL})$")) & plain.rlike(r"^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+$")
    return F.when(kind == EMAIL, email).when(kind == IP, passes(IP, plain)).when(kind == CARD, passes(CARD, plain)) \
        .otherwise(passes(PHONE, plain))


def number(flag: Column) -> Column:
    return flag.cast("double")


def features(kind: Column, txt: Column, left: Column, right: Column) -> dict[str, Column]:
    """Numbers that describe a span's format and what stands beside it."""
    runs = F.transform(F.regexp_extract_all(txt, F.lit("[0-9]+"), F.lit(0)), F.char_length)
    parts = F.transform(F.regexp_extract_all(txt, F.lit("[0-9]{1,9}"), F.lit(0)), lambda p: p.cast("int"))
    only = digits(txt)
    word = F.coalesce(*[F.when(kind == k, left.rlike(f"(?i){w}")) for k, w in _WORDS.items()])
    return {
        "kind": kind, "chars": F.char_length(txt), "digits": F.char_length(only),
        "letters": F.regexp_count(txt, F.lit(r"\p{L}")), "runs": F.size(runs), "longest": F.coalesce(F.array_max(runs), F.lit(0)),
        "shortest": F.coalesce(F.array_min(runs), F.lit(0)), "largest": F.least(F.coalesce(F.array_max(parts), F.lit(0)), F.lit(9999)),
        "first": F.coalesce(F.left(only, F.lit(1)).try_cast("int"), F.lit(-1)),
        "luhn": F.coalesce(luhn(only), F.lit(False)),
        "blanks": F.regexp_count(txt, F.lit("[ ]")), "dashes": F.regexp_count(txt, F.lit("-")), "dots": F.regexp_count(txt, F.lit("[.]")),
        "plus": F.startswith(txt, F.lit("+")), "zeros": F.startswith(txt, F.lit("00")), "brackets": F.regexp_count(txt, F.lit(r"[\[({]")),
        "at": F.contains(txt, F.lit("@")), "tail": F.char_length(F.regexp_extract(txt, r"[\p{L}]*$", 0)), "fits": fits(kind, txt),
        "digit_before": left.rlike(r"[0-9][ .-]?$"), "joined_before": left.rlike(r"[\p{L}\p{N}_/=:#&-]$"), "blank_before": left.rlike(r"\s$"),
        "digit_after": right.rlike(r"^[ .-]?[0-9]"), "joined_after": right.rlike(r"^[\p{L}\p{N}_/=@&-]"), "word_before": word,
    }


def numbers(spans: DataFrame, *keep: str) -> DataFrame:
    """The features of spans as columns ``f_``..., beside the columns to keep."""
    named = features(F.col("kind"), F.col("txt"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")))
    return spans.select(*keep, *[F.coalesce(number(v), F.lit(0.0)).alias(f"f_{k}") for k, v in named.items()])


def assembled(rows: DataFrame, *keep: str) -> DataFrame:
    """Feature columns put together in a vector."""
    names = [c for c in rows.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select(*keep, "features")


def described(spans: DataFrame, *keep: str) -> DataFrame:
    return assembled(numbers(spans, *keep), *keep)


def examples(scanned: DataFrame) -> DataFrame:
    """Labelled spans, of all texts, with ``held`` (true in the held-out fold), ``label``, ``kind``, ``txt``, ``left``, ``right``."""
    held = fold(F.col("key"))
    columns = ["row", "key", "s.*"]
    base = scanned.select("row", "key", F.explode("base").alias("s")).select(*columns, held.alias("held"))
    failing = scanned.select("row", "key", F.explode("proposed").alias("s")).select(*columns, held.alias("held"))
    failing = failing.where(~fits(F.col("kind"), F.col("txt")))
    kind, txt = F.col("kind"), F.col("txt")
    spelt = F.when(kind == EMAIL, F.regexp_replace(F.regexp_replace(txt, "@", " [at] "), r"\.(?=[A-Za-z0-9-]+$)", " [dot] ")) \
        .when(kind == IP, F.regexp_replace(txt, r"\.", "[.]")) \
        .when(kind == CARD, F.regexp_replace(digits(txt), "([0-9]{4})(?=[0-9])", "$1-")).otherwise(F.regexp_replace(txt, r"^\+", "00"))
    size = F.char_length(txt)
    damaged = [F.translate(txt, "0123456789", "7493826015"), F.left(txt, F.floor(size * 2 / 3).cast("int")),
               F.concat(txt, F.lit(" "), txt), F.concat(txt, F.regexp_replace(txt, "[^0-9]", ""))]

    def labelled(rows: DataFrame) -> DataFrame:
        good = [F.struct(F.lit(1.0).alias("label"), t.alias("txt")) for t in (txt, spelt)]
        bad = [F.when(~fits(kind, t), F.struct(F.lit(0.0).alias("label"), t.alias("txt"))) for t in damaged]
        variants = F.explode(F.filter(F.array(*good, *bad), lambda v: v.isNotNull())).alias("v")
        return rows.select("held", "row", "start", "kind", "left", "right", variants).select(
            "held", "row", "start", "kind", "left", "right", "v.*")

    rows = labelled(base).unionByName(failing.select(
        "held", "row", "start", "kind", "left", "right", F.lit(0.0).alias("label"), "txt"))
    swap = F.pmod(F.xxhash64("row", "start", "txt"), F.lit(6))
    left = F.when(swap == 0, F.lit("12 ")).when(swap == 1, F.lit("")).otherwise(F.col("left"))
    return rows.select("held", "label", "kind", "txt", left.alias("left"), "right")


def counted(rows: DataFrame) -> DataFrame:
    """Labelled spans by their features, with ``n``, how many are described alike; stored."""
    alike = numbers(rows, "held", "label", "kind")
    return staged(alike.groupBy(*alike.columns).agg(F.count(F.lit(1)).cast("double").alias("n")))


@dataclass(frozen=True)
class PiiModel:
    """Boosted trees (none: nothing is added) and the least score of each kind."""

    trees: GBTClassificationModel | None
    thresholds: tuple[float, ...]

    def scored(self, spans: DataFrame, *keep: str) -> DataFrame:
        return self.judged(described(spans, *keep), *keep)

    def judged(self, vectors: DataFrame, *keep: str) -> DataFrame:
        return self.trees.transform(vectors).select(*keep, vector_to_array("probability")[1].alias("score"))


def thresholds(scored: DataFrame, precision: float = PRECISION) -> tuple[float, ...]:
    """For each kind the least score, in steps of 1/1000 from 0.5, from which on the wanted share of the held-out spans is
    right; above 1 if there is none, or no held-out span that is right. A row counts ``n`` times if it has that column."""
    step = F.least(F.floor(F.col("score") * 1000), F.lit(999))
    times = F.col("n") if "n" in scored.columns else F.lit(1)
    bins = scored.groupBy("kind", step.alias("step")).agg(F.sum(times).alias("n"), F.sum(F.col("label") * times).alias("good"))
    above = Window.partitionBy("kind").orderBy(F.desc("step"))
    share = F.sum("good").over(above) / F.sum("n").over(above)
    least = bins.select("kind", "step", share.alias("share")).where((F.col("share") >= precision) & (F.col("step") >= 500))
    found = {r["kind"]: r["step"] / 1000 for r in least.groupBy("kind").agg(F.min("step").alias("step")).collect()}
    return tuple(found.get(k, 2.0) for k in range(len(KINDS)))


def fit_pii(scanned: DataFrame, precision: float = PRECISION) -> PiiModel:
    """Train on all spans of a scan and calibrate."""
    rows = counted(examples(scanned))
    labels = {r["label"] for r in rows.where(~F.col("held")).select("label").distinct().collect()}
    if labels != {0.0, 1.0}:
        return PiiModel(None, (2.0,) * len(KINDS))
    trees = GBTClassifier(maxIter=10, maxDepth=5, stepSize=0.3, seed=7, checkpointInterval=-1, weightCol="n").fit(
        assembled(rows.where(~F.col("held")), "label", "n"))
    model = PiiModel(trees, ())
    held = model.judged(assembled(rows.where("held"), "kind", "label", "n"), "kind", "label", "n")
    return PiiModel(trees, thresholds(held, precision))


def find_pii(scanned: DataFrame, model: PiiModel) -> DataFrame:
    """One row for each of the scan: ``row``, ``key``, ``base`` and ``added``, both lists of (start, kind, end) in order,
    the added ones with their score. A proposal that overlaps a base span is left out unless it holds it and is of its
    kind, and one within another added span of its kind."""
    found = F.array_sort(F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])))
    base = scanned.select("row", "key", found.alias("base"))
    nothing = F.array().cast(f"array<struct<start:{LONG},kind:int,end:{LONG},score:double>>")
    if model.trees is None:
        return base.withColumn("added", nothing)
    marked = F.concat(F.transform("base", lambda s: F.struct(F.lit(True).alias("is_base"), s.alias("s"))),
                      F.transform("proposed", lambda s: F.struct(F.lit(False).alias("is_base"), s.alias("s"))))
    spans = scanned.where(F.size("proposed") > 0).select("row", F.explode(marked).alias("m")).select("row", "m.is_base", "m.s.*")
    along = Window.partitionBy("row").orderBy("start")
    earlier, later = along.rangeBetween(Window.unboundedPreceding, -1), along.rangeBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("is_base"), F.struct("start", "kind", "end"))
    spans = spans.select("*", F.max(own["end"]).over(earlier).alias("reach"), F.min(own).over(later).alias("next"))
    clear = F.col("next").isNull() | (F.col("next.start") >= F.col("end"))
    holds = (F.col("next.kind") == F.col("kind")) & (F.col("next.end") <= F.col("end"))
    equal = (F.col("next.start") == F.col("start")) & (F.col("next.end") == F.col("end"))
    fresh = spans.where(~F.col("is_base") & (F.col("reach").isNull() | (F.col("reach") <= F.col("start"))) & (clear | (holds & ~equal)))
    least = F.get(F.array(*map(F.lit, model.thresholds)), F.col("kind"))
    taken = model.scored(fresh, "row", "start", "kind", "end").where(F.col("score") >= least)
    taken = taken.groupBy("row", "start", "kind", "end").agg(F.max("score").alias("score"))
    before = Window.partitionBy("row", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    added = taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("added"))
    return base.join(added, "row", "left").withColumn("added", F.coalesce("added", nothing))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end`` by start and kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of_kind(spans: Column, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover written as the kind of its first one, like ``[EMAIL]``."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.array().cast(f"array<struct<start:{LONG},kind:int,end:{LONG}>>").alias("done"))

    def join(state: Column, s: Column) -> Column:
        last = F.element_at(state["done"], -1)
        overlaps = (F.size(state["done"]) > 0) & (s["start"] < last["end"])
        grown = F.struct(last["start"], last["kind"], F.greatest(last["end"], s["end"]).alias("end"))
        kept = F.slice(state["done"], F.lit(1), F.size(state["done"]) - 1)
        return F.struct(F.when(overlaps, F.concat(kept, F.array(grown))).otherwise(F.concat(state["done"], F.array(s))).alias("done"))

    parts = F.transform(F.array_sort(spans), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    merged = F.reduce(parts, start, join)["done"]

    def pieces(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["m"], i - 1)["end"]).otherwise(F.lit(0).cast(LONG))
            gap = F.substring(x["t"], (before + 1).cast("int"), (s["start"] - before).cast("int"))
            return F.concat(gap, F.get(names, s["kind"]))

        last = F.when(F.size(x["m"]) > 0, F.element_at(x["m"], -1)["end"]).otherwise(F.lit(0).cast(LONG))
        tail = F.substring(x["t"], (last + 1).cast("int"), F.char_length(x["t"]))
        return F.concat(F.array_join(F.transform(x["m"], piece), ""), tail)

    return let(pieces, t=F.coalesce(text, F.lit("")), m=merged)
