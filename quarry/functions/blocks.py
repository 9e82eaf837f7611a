"""Blocks of code around a line, as column expressions: by lines, indentation, continuation, braces and def/end.

Each is one pass over the lines, or over the tokens that matter, from the given line on.  Lines are numbered from 1; a line
that is not there gives an empty block, null code gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
RUBY_OPENERS = ("def ", "class ", "module ", "begin")
CONTINUED = r"[\\,\{\[]$"
#: Lines below the given one in which a def is looked for.
RUBY_SLACK = 5
# --- end of fixed values ---

_BRACE_TOKENS = r"""\\["'`]|["'`{}/*\n]|[^"'`{}/*\n\\]+|\\"""
_BLANKS = r"^\s+|\s+$"


def lines_of(code: Column) -> Column:
    return F.split(code, "\n", -1)


def _let(value: Column, body) -> Column:
    """body(value), value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, _BLANKS, "")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def by_lines(code: Column, start: Column, end: Column) -> Column:
    """Lines start to end; empty where the range is not in the code."""
    fits = lambda x: (start >= 1) & (end <= F.size(x)) & (start <= end)
    cut = lambda x: F.when(fits(x), F.array_join(F.slice(x, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise(F.lit(""))
    return F.when(code.isNotNull(), _let(lines_of(code), cut))


def _block(code: Column, start: Column, last_of) -> Column:
    """The lines from start to last_of(lines, start)."""

    def cut(x: Column) -> Column:
        there = (start >= 1) & (start <= F.size(x))
        return F.when(there, F.array_join(F.slice(x, start, F.greatest(last_of(x) - start + 1, F.lit(0))), "\n")).otherwise(F.lit(""))

    return F.when(start.isNotNull() & code.isNotNull(), _let(lines_of(code), cut))


def by_indent(code: Column, start: Column) -> Column:
    """The line and what is indented deeper below it, blank lines included, up to the next line that is not."""

    def last(x: Column) -> Column:
        base = indent(F.get(x, start - 1))
        stops = F.transform(F.slice(x, start + 1, F.size(x)), lambda l: (_stripped(l) != "") & (indent(l) <= base))
        at = F.array_position(stops, True)
        return F.when(at == 0, F.size(x)).otherwise(start + at - 1)

    return _block(code, start, last)


def variable(code: Column, start: Column) -> Column:
    """The line and those below it as long as each ends with a backslash, a comma or an opening bracket."""

    def last(x: Column) -> Column:
        at = F.array_position(F.transform(F.slice(x, start, F.size(x)), lambda l: F.regexp_replace(l, r"\s+$", "").rlike(CONTINUED)), False)
        return F.when(at == 0, F.size(x)).otherwise(start + at - 1)

    return _block(code, start, last)


def signature_line(code: Column, signature: Column, hint: Column | None = None) -> Column:
    """The line that holds a signature, blanks aside and comment lines left out: the nearest to the hint, else the first; null where none does."""
    plain = lambda s: F.regexp_replace(_stripped(s), r"\s+", " ")
    wanted = plain(signature)
    comment = lambda l: _stripped(l).rlike(r"^(#|//)")
    found = F.filter(F.transform(lines_of(code), lambda l, i: F.when(~comment(l) & F.contains(plain(l), wanted), i + 1)), lambda i: i.isNotNull())
    if hint is None:
        return F.get(found, F.lit(0))
    near = F.array_min(F.transform(found, lambda i: F.struct(F.abs(i - hint).alias("far"), i.alias("line"))))["line"]
    return F.when(F.coalesce(hint, F.lit(0)) != 0, near).otherwise(F.get(found, F.lit(0)))


def ruby_method(code: Column, start: Column) -> Column:
    """From the def at the line, or up to RUBY_SLACK below, to the end that closes it, by counting openers and ends."""

    def opens(s: Column) -> Column:
        word = F.lit(False)
        for o in RUBY_OPENERS:
            word = word | F.startswith(s, F.lit(o))
        return word | F.contains(s, F.lit(" do")) | F.contains(s, F.lit("\tdo"))

    def step(acc: Column, line: Column) -> Column:
        def moved(s: Column) -> Column:
            depth = acc["depth"] + opens(s).cast("int")
            closes = ((s == "end") | F.startswith(s, F.lit("end "))) & (depth > 0)
            return F.struct((depth - closes.cast("int")).alias("depth"), (acc["at"] + 1).alias("at"), F.when(closes & (depth == 1), acc["at"] + 1).otherwise(F.lit(0)).alias("stop"))

        return F.when(acc["stop"] > 0, acc).otherwise(_let(_stripped(line), moved))

    def found(x: Column) -> Column:
        near = F.slice(x, start, F.lit(RUBY_SLACK + 1))
        at = F.array_position(F.transform(near, lambda l: F.startswith(_stripped(l), F.lit("def "))), True)
        first = F.when(at == 0, start).otherwise(start + at - 1).cast("int")
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("stop"))
        stop = F.aggregate(F.slice(x, first, F.size(x)), zero, step, lambda acc: acc["stop"])
        cut = lambda n: F.slice(x, first, F.when(n == 0, F.size(x)).otherwise(n))
        return F.when((start >= 1) & (start <= F.size(x)), F.array_join(_let(stop, cut), "\n")).otherwise(F.lit(""))

    return F.when(start.isNotNull() & code.isNotNull(), _let(lines_of(code), found))


def brace_method(code: Column, start: Column) -> Column:
    """From the line to the one on which its braces are closed, leaving out strings and comments.

    The fold's state: depth, whether a brace was opened, the quote of the open string, block and line comment, the slash or
    star just read (two of them open or close comments), the line, and the line of the last brace.
    """
    none, no, zero = F.lit(""), F.lit(False), F.lit(0)
    begin = F.struct(zero.alias("depth"), no.alias("open"), none.alias("quote"), no.alias("block"), no.alias("rest"), none.alias("mark"), F.lit(1).alias("line"), zero.alias("stop"))

    def step(s: Column, t: Column) -> Column:
        newline, quote, sign = t == "\n", s["quote"] != "", t.isin("/", "*")
        live = ~s["rest"] & ~quote
        pair = F.concat(s["mark"], t)
        to_rest = live & (pair == "//")
        opened = live & (pair == "/*")
        closed = live & s["block"] & (pair == "*/")
        # a mark is only what may begin a pair: not one that has just ended one
        mark = F.when(live & sign & ~opened & ~closed, t).otherwise(none)
        plain = ~s["rest"] & ~s["block"] & ~to_rest
        toggles = plain & t.isin('"', "'", "`")
        now = F.when(toggles & ~quote, t).when(toggles & quote & (t == s["quote"]), none).otherwise(s["quote"])
        counts = plain & ~quote
        up, down = counts & (t == "{"), counts & (t == "}")
        depth = s["depth"] + up.cast("int") - down.cast("int")
        moved = F.struct(
            depth.alias("depth"), (s["open"] | up).alias("open"), now.alias("quote"), ((s["block"] | opened) & ~closed).alias("block"), ((s["rest"] | to_rest) & ~newline).alias("rest"),
            F.when(newline, none).otherwise(mark).alias("mark"), (s["line"] + newline.cast("int")).alias("line"), F.when(down & s["open"] & (depth == 0), s["line"]).otherwise(zero).alias("stop"),
        )
        return F.when(s["stop"] > 0, s).otherwise(moved)

    def found(x: Column) -> Column:
        rest = F.slice(x, start, F.size(x))
        tokens = F.regexp_extract_all(F.array_join(rest, "\n"), F.lit(_BRACE_TOKENS), F.lit(0))
        stop = F.aggregate(tokens, begin, step, lambda s: s["stop"])
        cut = lambda n: F.slice(rest, F.lit(1), F.when(n == 0, F.size(rest)).otherwise(n))
        return F.when((start >= 1) & (start <= F.size(x)), F.array_join(_let(stop, cut), "\n")).otherwise(F.lit(""))

    return F.when(start.isNotNull() & code.isNotNull(), _let(lines_of(code), found))
