"""Scalar columns: cleaning, partial dates, ratings, results, keys and text output.

Every function takes and returns a ``Column``; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "unknown" in record headers.
UNKNOWN = ["", "?", "-", "??", "???"]

# Result code 0..3 in this order.
RESULTS = ["*", "1-0", "0-1", "1/2-1/2"]

# Tags that have a column of their own.
MAIN_TAGS = [
    "Event", "Site", "Date", "Round", "White", "Black", "Result", "WhiteElo", "BlackElo",
    "ECO", "FEN", "SetUp", "PlyCount", "Opening", "Variation",
]

MOVE_END = 65535  # fixed value: the sequence stopped in this state
NULL_MOVE = 0  # fixed value: a passed turn


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Work ``value`` out once for a body that uses it often (a lambda would repeat it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column | str) -> Column:
    """Collapse whitespace; texts that mean "unknown" become NULL."""
    text = F.trim(F.regexp_replace(col(c), r"[\s\x{00a0}\x{feff}]+", " "))
    return F.when(~text.isin(UNKNOWN), text)


def parse_partial_date(c: Column | str) -> Column:
    """``2020.05.??`` -> 20200500. Unknown or impossible parts are 00, no year is NULL."""
    pattern = r"(?s)^\s*(\d{4})(?:[.\-/](\d{2}|\?\?)[.\-/](\d{2}|\?\?).*|\s*)$"

    def part(n: int) -> Column:
        # Nothing and ``??`` read as 0; all other matches are digits.
        return F.concat(F.lit("0"), F.replace(F.regexp_extract(col(c), pattern, n), F.lit("?"), F.lit("0"))).cast("int")

    def number(p: Column) -> Column:
        month = F.when(p["m"].between(1, 12), p["m"]).otherwise(0)
        day = F.when((month > 0) & p["d"].between(1, 31), p["d"]).otherwise(0)
        return F.when(p["y"].between(1000, 2999), p["y"] * 10000 + month * 100 + day)

    return let(F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), number)


def first_date(*candidates: Column | str) -> Column:
    """The first of several date tags that holds a usable date."""
    return F.coalesce(*[parse_partial_date(c) for c in candidates])


def format_partial_date(c: Column | str, short: bool = False) -> Column:
    """20200500 -> ``2020.05.??``; the short form leaves trailing unknown parts out."""
    date = col(c)
    year = F.floor(date / 10000).cast("string")
    month = F.floor(date / 100).cast("int") % 100
    day = date % 100

    def part(value: Column) -> Column:
        return F.when(value > 0, F.lpad(value.cast("string"), 2, "0")).otherwise("??")

    full = F.concat_ws(".", year, part(month), part(day))
    text = F.when(date.isNull() | (date == 0), "????.??.??").otherwise(full)
    return F.replace(text, F.lit(".??"), F.lit("")) if short else text


def year_of(c: Column | str) -> Column:
    return F.floor(col(c) / 10000).cast("smallint")


def date_bound(text: str, upper: bool) -> int | None:
    """Bound of a date filter: missing parts are padded down (00) or up (12, 31)."""
    import re

    m = re.fullmatch(r"(\d{4})(?:[.\-/](\d{1,2}))?(?:[.\-/](\d{1,2}))?", text.strip(), re.ASCII)
    if not m:
        return None
    month = int(m[2]) if m[2] else (12 if upper else 0)
    day = int(m[3]) if m[3] else (31 if upper else 0)
    return int(m[1]) * 10000 + month * 100 + day


def parse_rating(c: Column | str) -> Column:
    """Leading integer within 1..3999, else NULL."""
    digits = F.concat(F.lit("0"), F.regexp_extract(col(c), r"^\s*\+?0*(\d{0,5})", 1))
    n = digits.cast("int")
    return F.when(n.between(1, 3999), n)


def result_code(c: Column | str) -> Column:
    """Result text -> 0..3; anything unknown (or missing) is 0."""
    code = F.array_position(F.array(*[F.lit(r) for r in RESULTS]), col(c)) - 1
    return F.greatest(F.coalesce(code, F.lit(0)), F.lit(0)).cast("tinyint")


def result_text(c: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RESULTS]), col(c).cast("int") + 1)


def min_rating(white: Column | str, black: Column | str) -> Column:
    w, b = col(white), col(black)
    return F.when(w.isNotNull() & b.isNotNull(), F.least(w, b))


def max_rating(white: Column | str, black: Column | str) -> Column:
    return F.greatest(col(white), col(black))


def mean_rating(white: Column | str, black: Column | str) -> Column:
    """Rounded mean of both ratings, or the one that is known."""
    w, b = col(white), col(black)
    return F.coalesce(F.floor((w + b + 1) / 2).cast("int"), w, b)


def eco_or(header: Column | str, classified: Column | str) -> Column:
    """Header code when it is well formed, else the code of the classified opening."""
    code = F.upper(clean(header))
    return F.coalesce(F.when(code.rlike(r"^[A-E]\d\d$"), code), col(classified))


def extra_tags(tags: Column | str) -> Column:
    """Tags without a column of their own, as JSON; NULL when there are none."""
    rest = F.map_filter(col(tags), lambda k, v: ~k.isin(MAIN_TAGS))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def json_tags(c: Column | str) -> Column:
    return F.from_json(col(c), "map<string,string>")


def full_moves(plies: Column | str) -> Column:
    return F.ceil(col(plies) / 2).cast("int")


def share(part: Column | str, total: Column | str) -> Column:
    """Percent of the row's games; 0 where there are none."""
    return F.when(col(total) > 0, 100.0 * col(part) / col(total)).otherwise(0.0)


# ---- move keys: from | to << 6 | promotion << 12 --------------------------------------

PROMOTIONS = " nbrq"  # fixed values: code of a promotion piece is index + 1 (2..5)


def move_key(src: Column | str, dst: Column | str, promo: Column | str | None = None) -> Column:
    key = col(src).bitwiseOR(F.shiftleft(col(dst).cast("int"), 6))
    if promo is not None:
        key = key.bitwiseOR(F.shiftleft(col(promo).cast("int"), 12))
    return key.cast("int")


def move_parts(c: Column | str) -> Column:
    m = col(c).cast("int")
    return F.struct(
        m.bitwiseAND(63).alias("src"),
        F.shiftright(m, 6).bitwiseAND(63).alias("dst"),
        F.shiftright(m, 12).bitwiseAND(7).alias("promo"),
    )


def square_name(square: Column) -> Column:
    file = F.substring(F.lit("abcdefgh"), square % 8 + 1, F.lit(1))
    return F.concat(file, (F.floor(square / 8) + 1).cast("string"))


def move_to_uci(c: Column | str) -> Column:
    p = move_parts(c)
    promo = F.when(p["promo"] > 0, F.substring(F.lit(PROMOTIONS), p["promo"], F.lit(1))).otherwise("")
    text = F.concat(square_name(p["src"]), square_name(p["dst"]), promo)
    return F.when(col(c).bitwiseAND(0x7FFF) == NULL_MOVE, "0000").otherwise(text)


def uci_to_move(c: Column | str) -> Column:
    text = col(c)

    def square(start: int) -> Column:
        file = F.instr(F.lit("abcdefgh"), F.substring(text, start, 1)) - 1
        return file + (F.substring(text, start + 1, 1).try_cast("int") - 1) * 8

    promo = F.when(F.length(text) > 4, F.instr(F.lit(PROMOTIONS), F.substring(text, 5, 1))).otherwise(0)
    key = move_key(square(1), square(3), promo)
    return F.when(text.isin("0000", "--"), NULL_MOVE).when(
        text.rlike("^[a-h][1-8][a-h][1-8][nbrq]?$"), key
    )


# ---- position text ---------------------------------------------------------------------


def epd_key(c: Column | str) -> Column:
    """The first four fields: equal texts differ at most in their counters."""
    return F.array_join(F.slice(F.split(F.trim(col(c)), r"\s+"), 1, 4), " ")


def start_ply(c: Column | str) -> Column:
    """Ply number of a start position: from its move counter and the side to move."""
    parts = F.split(F.regexp_replace(col(c), r"^\s+", ""), r"\s+")
    digits = F.regexp_extract(F.coalesce(F.get(parts, F.lit(5)), F.lit("1")), r"^(\d{1,6})", 1)
    number = F.concat(F.lit("0"), digits).cast("int")
    number = F.when(number > 0, number).otherwise(1)
    return F.coalesce(
        (number - 1) * 2 + F.when(F.get(parts, F.lit(1)) == "b", 1).otherwise(0), F.lit(0)
    ).cast("int")


def spread_board(c: Column | str) -> Column:
    """Piece placement of a position text as 64 characters, a8 first, ``.`` = empty."""
    board = F.replace(F.substring_index(col(c), " ", 1), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return board


def pack_board(board: Column | str) -> Column:
    """64 characters -> the ranks of a position text."""
    ranks = F.concat_ws("/", *[F.substring(col(board), 1 + 8 * r, 8) for r in range(8)])
    for n in range(8, 0, -1):
        ranks = F.replace(ranks, F.lit("." * n), F.lit(str(n)))
    return ranks


def insufficient_material(epd: Column | str) -> Column:
    """Bare kings, one minor piece, or only bishops that share a square colour."""
    # Squares of one colour: (row + file) even, in reading order.
    light = F.lit("".join("L" if (i // 8 + i % 8) % 2 == 0 else "D" for i in range(64)))

    def poor(board: Column) -> Column:
        pieces = F.regexp_replace(board, r"[.kK]", "")
        bishops = F.filter(
            F.sequence(F.lit(1), F.lit(64)), lambda i: F.substring(board, i, F.lit(1)).isin("b", "B")
        )
        colours = F.array_distinct(F.transform(bishops, lambda i: F.substring(light, i, F.lit(1))))
        bishops_only = ~pieces.rlike("[nN]") & (F.size(colours) <= 1)
        return ~pieces.rlike("[pPrRqQ]") & ((F.length(pieces) <= 1) | bishops_only)

    return let(spread_board(epd), poor)


def ending_kind(last_token: Column | str, epd: Column | str) -> Column:
    """``mate`` by the recorded token, ``insufficient`` by the last position, else NULL."""
    return F.when(col(last_token).rlike(r"#$"), "mate").when(insufficient_material(epd), "insufficient")


# ---- text output ----------------------------------------------------------------------


def escape_tag(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r'(["\\])', r"\\$1")


def tag_line(name: str | Column, value: Column) -> Column:
    label = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit("["), label, F.lit(' "'), escape_tag(value), F.lit('"]'))


def headers(
    *, event, site, date, round, white, black, result, white_elo=None, black_elo=None, eco=None,
    opening=None, tags=None, start_state=None,
) -> Column:
    """Ordered header list: seven standard tags with defaults, then whatever is known."""

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    def optional(name: str, value) -> Column:
        if value is None:
            return F.lit(None)
        # A rating of 0 and an empty text count as absent.
        known = ~F.coalesce(col(value).cast("string"), F.lit("")).isin("", "0")
        return F.when(known, pair(name, col(value)))

    fixed = F.array(
        pair("Event", F.coalesce(col(event), F.lit("?"))),
        pair("Site", F.coalesce(col(site), F.lit("?"))),
        pair("Date", format_partial_date(date)),
        pair("Round", F.coalesce(col(round), F.lit("?"))),
        pair("White", col(white)),
        pair("Black", col(black)),
        pair("Result", result_text(result)),
        optional("WhiteElo", white_elo),
        optional("BlackElo", black_elo),
        optional("ECO", eco),
        optional("Opening", opening),
    )
    parts = [F.array_compact(fixed)]
    empty = F.slice(fixed, 1, 0)
    if tags is not None:
        entries = F.transform(
            F.map_entries(col(tags)),
            lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")),
        )
        parts.append(F.coalesce(entries, empty))
    if start_state is not None:
        setup = F.array(pair("SetUp", F.lit("1")), pair("FEN", col(start_state)))
        parts.append(F.when(col(start_state).isNotNull(), setup).otherwise(empty))
    return F.concat(*parts)


def movetext_of(tokens: Column | str, result: Column | str, first_ply: Column | int = 0) -> Column:
    """Numbered movetext: ``1. a b 2. c``; ``1... b`` when the second side starts."""
    start = F.lit(first_ply) if isinstance(first_ply, int) else first_ply

    def numbered(token: Column, i: Column) -> Column:
        ply = start + i
        number = (F.floor(ply / 2) + 1).cast("string")
        return (
            F.when(ply % 2 == 0, F.concat(number, F.lit(". "), token))
            .when(i == 0, F.concat(number, F.lit("... "), token))
            .otherwise(token)
        )

    return F.array_join(
        F.concat(F.transform(col(tokens), numbered), F.array(col(result))), " "
    )


def wrap(c: Column | str, width: int = 80) -> Column:
    """Break at spaces so that no line is longer than ``width`` (single longer words stay whole)."""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    if width <= 0:
        return text
    broken = F.regexp_replace(text, rf"(\S.{{0,{width - 1}}}|\S+)(?: |$)", "$1\n")
    return F.rtrim(broken, F.lit("\n"))


def format_record(header_list: Column | str, movetext: Column | str) -> Column:
    """Tag lines, a blank line, the movetext."""
    lines = F.transform(col(header_list), lambda h: tag_line(h["name"], h["value"]))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), col(movetext), F.lit("\n"))
