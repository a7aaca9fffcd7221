"""Record text -> columns. All regular expressions and array functions, no Python in the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ludograph.functions.columns import col, let

# Annotation glyphs and evaluation symbols with their numeric codes.
GLYPHS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
SYMBOLS = {
    "=": 10, "∞": 13, "+=": 14, "⩲": 14, "=+": 15, "⩱": 15, "+/-": 16, "±": 16, "-/+": 17, "∓": 17,
    "+-": 18, "-+": 19, "N": 146, "□": 7,
}

# Spellings of a result inside movetext.
RESULT_TOKENS = ["1-0", "0-1", "*", "1/2-1/2", "½-½", "1/2", "0.5-0.5"]

# Fixed values of the move notation: letters of pieces, files, ranks, signs behind a move, and spellings of a pass.
PIECES, FILES, RANKS = "KQRBNP", "a-h", "1-8"
PASSES = ["--", "0000", "@@", "Z0"]

# Its grammar. A man goes from a place, which may be told in full, by file or rank alone, or not at all, to a square; a
# pawn that gets there may become a piece. Castling is two or three letters o, one for each square the king passes.
_SQUARE = f"[{FILES}][{RANKS}]"
_FROM = f"(?:{_SQUARE}|[{FILES}]|[{RANKS}])??"
_BECOMES = "(?:=?[QRBNqrbn])?"
_MAN = f"[{PIECES}]?{_FROM}[-x:]?{_SQUARE}{_BECOMES}"
_CASTLE = "[0O](?:-?[0O]){1,2}"
_TOLD = r"[#+]*(?:e\.p\.)?"
_MOVE = f"(?:{_MAN}|{_CASTLE}|{'|'.join(PASSES)}){_TOLD}"
MOVE_SHAPE = f"^{_MOVE}$"

# A word is bounded by these; a move may carry its number in front and glyphs behind.
# Spelled out, because a class of single characters is looked up in a table.
_BREAK = r" \t\n\x0B\f\r\x{a0}\x{feff}{}()\[\];$\""
_END = rf"(?![^{_BREAK}])"
_NUMBER = r"(?:(?!0-0|0000)\d++\.*+|\.++)?+"
_MOVE_WORD = rf"{_NUMBER}({_MOVE})"
# Group 1 is the move, empty for other words. Every word is taken whole, so matches begin at words.
MOVE_WORDS = rf"{_MOVE_WORD}[!?]*+{_END}|[^{_BREAK}]++"
# The look ahead fails at once on most characters, before the costlier look behind.
RESULT_WORDS = rf"(?=[01*½])(?<![^{_BREAK}])(1-0|0-1|\*|1/2-1/2|½-½|1/2|0\.5-0\.5){_END}"

BRACE_COMMENT = r"\{[^}]*(?:\}|\z)"
LINE_COMMENT = r";[^\n]*"
ESCAPE_LINE = r"(?m:^[ \t\r]*%[^\n]*)"
_SPACE = r"[\s\x{00a0}\x{feff}]"
# A tag value: escapes, and quotes that do not close it (no bracket or line end behind them).
_VALUE = r"(?:[^\"\\\n]++|\\[\"\\]|\\|\"(?![ \t]*(?:\]|\r|\n|\z)))*+"
_SYMBOL = rf"[^{_BREAK}]++"


# One tag, or a line to pass over: name, then a quoted value (group 2 begins with the quote) or bare words up to the
# bracket or line end. Each match takes the whole tag, so brackets inside a value begin no other.
_TAG = rf"{ESCAPE_LINE}|\[\s*+([^\s\"\]]++)[^\S\n]*+(\"{_VALUE}|[^\"\]\n][^\]\n]*+)?+\"?+[^\]\n]*+\]?+"


def tags(c: Column | str, name: str | None = None) -> Column:
    """Tag pairs as a map: escapes undone, a repeated tag keeps its last value.

    Values may stand without quotes or without the closing one, names may hold any sign but blanks, quotes and the
    closing bracket, and a line may hold several tags. ``name`` is a pattern that keeps only some names.
    """
    return tags_of(tag_section(c), name)


def tags_of(head: Column, name: str | None = None) -> Column:
    """The same, for a tag section already cut off."""
    entry = "struct<key:string,value:string>"

    def pairs(head: Column) -> Column:
        keys = F.regexp_extract_all(head, F.lit(_TAG), F.lit(1))
        values = F.regexp_extract_all(head, F.lit(_TAG), F.lit(2))
        quoted = lambda v: F.when(v.startswith('"'), _unescaped(F.substr(v, F.lit(2)))).otherwise(trimmed(v))
        found = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), quoted(v).alias("value")))
        wanted = lambda e: e["key"].rlike(rf"\A(?:{name})\z") if name else e["key"] != ""
        return F.filter(found, wanted)

    def newest(found: Column) -> Column:
        # Independent of the session's policy for repeated map keys.
        return F.aggregate(
            found, F.array().cast(f"array<{entry}>"),
            lambda acc, e: F.concat(F.filter(acc, lambda o: o["key"] != e["key"]), F.array(e)),
        )

    def as_map(found: Column) -> Column:
        names = F.transform(found, lambda e: e["key"])
        single = F.size(F.array_distinct(names)) == F.size(found)
        return F.when(single, F.map_from_entries(found)).otherwise(F.map_from_entries(newest(found)))

    return let(let(head, pairs), as_map)


def _unescaped(v: Column) -> Column:
    return F.when(v.contains("\\"), F.regexp_replace(v, r'\\(["\\])', "$1")).otherwise(v)


_HEAD = (
    r"(?s)^((?:[\s\x{feff}]++|%[^\n]*+(?:\n|\z)"
    r"|\[(?:[^\]\"\n]++|\"(?:[^\"\\\n]++|\\[^\n])*+(?:\"|(?=\n)|\z))*+(?:\]|(?=\n)|\z))*+)"
)


def tag_section(c: Column | str) -> Column:
    """The leading run of tag lines, escape lines and blanks."""
    return F.regexp_extract(col(c), _HEAD, 1)


def movetext(c: Column | str) -> Column:
    """Everything after the tag section, trimmed."""
    return body_of(col(c), tag_section(c))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r\u00a0\ufeff"))


def body_of(raw: Column, head: Column) -> Column:
    """The same, given the tag section."""
    return trimmed(F.substr(raw, F.length(head) + 1))


def without_comments(c: Column | str) -> Column:
    """Movetext with comments and escape lines blanked, cut where another record's tags begin."""
    text = F.regexp_replace(col(c), f"{BRACE_COMMENT}|{LINE_COMMENT}|{ESCAPE_LINE}", " ")
    return F.regexp_replace(text, r"(?s)\[.*", "")


def mainline_text(c: Column | str) -> Column:
    """Movetext outside every ``( )``, to any depth.

    Works on the pieces between parentheses, so its cost follows the number of variations and is
    one regular expression for the many records that have none.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        depth = (
            F.when(piece == "(", acc["depth"] + 1)
            .when(piece == ")", F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        keep = (acc["depth"] == 0) & ~piece.isin("(", ")")
        out = F.when(keep, F.concat(acc["out"], F.lit(" "), piece)).otherwise(acc["out"])
        return F.struct(depth.alias("depth"), out.alias("out"))

    def outer(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r"([()]|[^()]+)"), F.lit(1))
        nested = F.aggregate(pieces, start, step, lambda acc: acc["out"])
        return F.when(text.contains("(") | text.contains(")"), nested).otherwise(text)

    return let(without_comments(c), outer)


def is_result(token: Column) -> Column:
    return token.isin(RESULT_TOKENS)


def bare_move(token: Column) -> Column:
    """A word without move number, dots and trailing glyphs."""
    word = F.when(token.startswith("0-0") | (token == "0000"), token).otherwise(
        F.regexp_replace(token, r"^\d+\.*|^\.+", "")
    )
    word = F.regexp_replace(F.regexp_replace(word, r"^\.+", ""), r"[!?]+$", "")
    return F.when(word == "0000", "--").otherwise(word)


def moves_of(main: Column) -> Column:
    """Move words of main-line text, up to the first result."""
    first = F.regexp_replace(main, rf"(?s){RESULT_WORDS}.*", "")
    words = F.filter(F.regexp_extract_all(first, F.lit(MOVE_WORDS), F.lit(1)), lambda w: w != "")
    plain = lambda w: F.transform(w, lambda m: F.when(m == "0000", "--").otherwise(m))
    return F.when(main.contains("0000"), plain(words)).otherwise(words)


def words_of(main: Column) -> Column:
    """All words of main-line text but numbers in front of steps, up to the first result."""
    first = F.regexp_replace(main, rf"(?s){RESULT_WORDS}.*", "")
    return F.filter(F.regexp_extract_all(first, F.lit(rf"[^{_BREAK}]++"), F.lit(0)), lambda w: ~w.rlike(r"^\d+\.+$"))


def result_of(main: Column) -> Column:
    """The last result of main-line text, in its usual spelling; NULL if there is none."""
    last = F.get(F.reverse(F.regexp_extract_all(main, F.lit(RESULT_WORDS), F.lit(1))), F.lit(0))
    return F.when(last.isin("*", "1-0", "0-1"), last).when(last.isNotNull(), F.lit("1/2-1/2"))


def mainline_tokens(c: Column | str) -> Column:
    """Move words of the main line, up to the first result."""
    return let(mainline_text(c), moves_of)


def result_token(c: Column | str) -> Column:
    """The result written in the main line (the last one); NULL if none."""
    return let(mainline_text(c), result_of)


def nag_codes(token: Column) -> Column:
    """Numeric code of one annotation word: ``$n``, a glyph, a symbol, or glyphs after a move."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in {**GLYPHS, **SYMBOLS}.items() for x in kv]), token)
    tail = F.element_at(
        F.create_map(*[F.lit(x) for kv in GLYPHS.items() for x in kv]),
        F.regexp_extract(token, r"^.*?[^!?]([!?]+)$", 1),
    )
    return (
        F.when(token.startswith("$"), F.substr(token, F.lit(2)).try_cast("int"))
        .when(code.isNotNull(), code)
        .when(bare_move(token).rlike(MOVE_SHAPE), tail)
    )


def nags(c: Column | str) -> Column:
    """All annotation codes of a movetext, in order."""
    words = F.regexp_extract_all(without_comments(c), F.lit(rf"(\$\d*|{_SYMBOL})"), F.lit(1))
    return F.array_compact(F.transform(words, nag_codes))


def comments(c: Column | str) -> Column:
    """Texts of brace and rest-of-line comments, trimmed, in order."""
    found = F.regexp_extract_all(col(c), F.lit(f"({ESCAPE_LINE}|{BRACE_COMMENT}|{LINE_COMMENT})"), F.lit(1))
    kept = F.filter(found, lambda t: t.startswith("{") | t.startswith(";"))
    return F.transform(kept, lambda t: F.regexp_replace(t, rf"^[{{;]{_SPACE}*|{_SPACE}*\}}?\z", ""))


def is_annotated(c: Column | str) -> Column:
    """True when there is any comment, annotation code or variation."""
    body = F.regexp_replace(col(c), ESCAPE_LINE, " ")
    sure = body.rlike(r"[{;(]|\$\d")
    # Without any of these characters there is no glyph or symbol to look for.
    maybe = body.rlike(r"[!?=∞⩲⩱±∓□]|[+-]/?[+-]|N(?:[\s$]|\z)")
    return F.when(sure, True).when(maybe, F.size(nags(c)) > 0).otherwise(False)


# Pieces of a text of several games: a parenthesis, a result, a run of units that open no game, or a run that begins with
# one that may: a move, or a bare number, which is written in front of the move.
_RESULT_UNIT = rf"(?=[01*½])(?:1-0|0-1|\*|1/2-1/2|½-½|1/2|0\.5-0\.5){_END}"
_OPENING = rf"(?:\d++\.*+|(?:(?!0-0|0000{_END})\d++\.*+|\.++)?+{_MOVE}[!?]*+)[\x{{85}}\x{{2028}}\x{{2029}}]?+{_END}"
_NO_WORD = rf"\{{[^}}]*+\}}?+|{LINE_COMMENT}|\$\d*+|{_SPACE}++|[}}\[\]\"]"
_PIECES = (
    rf"[()]|{_RESULT_UNIT}"
    rf"|{_OPENING}(?:{ESCAPE_LINE}|(?!{_RESULT_UNIT}){_SYMBOL}|{_NO_WORD})*+"
    rf"|(?:{ESCAPE_LINE}|(?!{_RESULT_UNIT}|{_OPENING}){_SYMBOL}|{_NO_WORD})++"
)


def split_by_result(c: Column | str) -> Column:
    """Movetext of several header-less games in a row -> one text per game.

    A game ends with its result; comments and codes behind the result still belong to it, the next
    move (or result) starts another one. Depth and comments are honoured, so a ``1-0`` inside either
    does not split.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("ended"), F.array(F.lit(1)).alias("begins"),
    )

    # Only the places where games begin are kept while walking; the texts are cut once, at the end. A game begins with a
    # piece, and what a piece begins with is only asked behind a result.
    def step(acc: Column, t: Column) -> Column:
        depth = F.when(t == "(", acc["depth"] + 1).when(t == ")", F.greatest(acc["depth"] - 1, F.lit(0)))
        depth = depth.otherwise(acc["depth"])
        ends = (acc["depth"] == 0) & is_result(t)
        opens = acc["ended"] & (ends | t.rlike(rf"\A{_OPENING}"))
        return F.struct(
            (acc["at"] + 1).alias("at"),
            depth.alias("depth"),
            F.when(opens, ends).otherwise(acc["ended"] | ends).alias("ended"),
            F.when(opens, F.concat(acc["begins"], F.array(acc["at"] + 1))).otherwise(acc["begins"]).alias("begins"),
        )

    def games(many: Column) -> Column:
        def cut(begins: Column) -> Column:
            ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(many) + 1))
            return F.zip_with(begins, ends, lambda a, b: trimmed(F.array_join(F.slice(many, a, b - a), "")))

        return let(F.aggregate(many, start, step, lambda a: a["begins"]), cut)

    # At most one result in the whole text: nothing to split, and no walk over the words.
    several = F.regexp_count(col(c), F.lit(RESULT_WORDS)) > 1
    split = let(F.regexp_extract_all(col(c), F.lit(_PIECES), F.lit(0)), games)
    return F.when(several, split).otherwise(F.array(trimmed(col(c))))


# ---- commands inside comments -----------------------------------------------------------

# A command is a bracket that begins with a percent sign, a name and a blank.
COMMAND = r"\[%(?=\w++\s)[^\]]*+\]"

# Colour codes of arrows and marked squares.
COLOURS = {"G": "#15781b", "R": "#882020", "Y": "#e68f00", "B": "#003088"}


def commands(c: Column | str) -> Column:
    """The commands of a comment: name and argument, in order."""
    def read(command: Column) -> Column:
        inner = F.substring(command, F.lit(3), F.char_length(command) - 3)
        name = F.regexp_extract(inner, r"^\w+", 0)
        return F.struct(name.alias("name"), F.trim(F.regexp_replace(F.substring(inner, F.char_length(name) + 1, F.char_length(inner)), r"^\s+", "")).alias("arg"))

    return F.transform(F.regexp_extract_all(col(c), F.lit(COMMAND), F.lit(0)), read)


def _drawn(found: Column, name: str, squares: int) -> Column:
    """Words of all commands of a name that are a colour and so many squares: the colour's code, and the squares."""
    codes = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    words = F.split(F.array_join(F.transform(F.filter(found, lambda e: e["name"] == name), lambda e: e["arg"]), ","), ",")
    fit = F.filter(F.transform(words, F.trim), lambda w: w.rlike(f"^[{''.join(COLOURS)}](?:{_SQUARE}){{{squares}}}$"))
    return F.transform(fit, lambda w: F.struct(
        F.element_at(codes, F.left(w, F.lit(1))).alias("colour"), F.regexp_extract_all(w, F.lit(_SQUARE), F.lit(0)).alias("squares")))


def comment_commands(c: Column | str) -> Column:
    """Struct of text (without commands), clock, eval, arrows, highlights of one comment."""
    def read(p: Column) -> Column:
        def told(name: str) -> Column:  # the last of a name counts
            same = F.filter(p["found"], lambda e: e["name"] == name)
            return F.when(F.size(same) > 0, F.element_at(same, -1)["arg"])

        arrow = lambda m: F.struct(m["colour"].alias("colour"), m["squares"][0].alias("src"), m["squares"][1].alias("dst"))
        field = lambda m: F.struct(m["colour"].alias("colour"), m["squares"][0].alias("square"))
        words = F.filter(F.split(F.regexp_replace(p["raw"], COMMAND, " "), r"\s+"), lambda w: w != "")
        return F.struct(
            F.array_join(words, " ").alias("text"),
            # Hours of nought and parts of a second are left out.
            F.regexp_extract(told("clk"), r"(?s)^(?:0:)?(.*?)(?:\.\d+)?$", 1).alias("clock"),
            F.get(F.split(told("eval"), ",", 2), F.lit(0)).alias("eval"),
            F.transform(_drawn(p["found"], "cal", 2), arrow).alias("arrows"),
            F.transform(_drawn(p["found"], "csl", 1), field).alias("highlights"),
        )

    return let(F.struct(col(c).alias("raw"), commands(c).alias("found")), read)


def strip_annotations(
    c: Column | str, comments: bool = True, variations: bool = True, nags: bool = True
) -> Column:
    """Movetext with comments, variations or annotation codes left out (``True`` keeps them).

    Numbers are kept as written, except that ``n...`` after a dropped insertion is dropped too.
    """
    text = F.regexp_replace(col(c), ESCAPE_LINE, " ")
    if not comments:
        text = F.regexp_replace(text, f"{BRACE_COMMENT}|{LINE_COMMENT}", " ")
    if not variations:
        # Parentheses inside comments do not count, so split into comments, parens and the rest.
        unit = rf"({BRACE_COMMENT}|{LINE_COMMENT}|[()]|[^(){{;]+)"
        pieces = F.regexp_extract_all(text, F.lit(unit), F.lit(1))
        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            depth = F.when(p == "(", acc["depth"] + 1).when(p == ")", F.greatest(acc["depth"] - 1, F.lit(0)))
            out = F.when((acc["depth"] == 0) & ~p.isin("(", ")"), F.concat(acc["out"], p))
            return F.struct(
                depth.otherwise(acc["depth"]).alias("depth"), out.otherwise(acc["out"]).alias("out")
            )

        text = F.aggregate(pieces, start, step, lambda a: a["out"])
    if not nags:
        # Outside comments only: codes, glyphs behind moves, and stand-alone symbols.
        kept = rf"({BRACE_COMMENT}|{LINE_COMMENT})|\$\d+|(?<=[a-h1-8NBRQO+#0-])[!?]+(?=[\s(){{;]|\z)"
        text = F.regexp_replace(text, kept, "$1")
        words = "|".join(rf"\Q{s}\E" for s in sorted({**GLYPHS, **SYMBOLS}, key=len, reverse=True))
        alone = rf"({BRACE_COMMENT}|{LINE_COMMENT})|(?<=[\s()}}]|^)(?:{words})(?=[\s(){{;]|\z)"
        text = F.regexp_replace(text, alone, "$1")
    text = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    if not comments and not variations:
        text = F.regexp_replace(text, r"(?<=\S )\d+\.\.\.\s*", "")
    return text
