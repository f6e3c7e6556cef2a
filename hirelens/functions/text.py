"""Column-level text functions (all JVM-side except the Unicode normalizer).

Python's ``str`` methods and ``re`` classes are Unicode-aware; Java's
defaults are not. Every rule here spells out the character classes
explicitly so that Spark (java.util.regex) reproduces the Python
semantics code point for code point:

* word character  ``W``  = letters, numbers, underscore
* whitespace      ``WS`` = what ``str.isspace`` accepts
* digit           ``D``  = decimal digits (category Nd)

Patterns are handed to Spark through the Python API (never inside SQL
literals, which would eat the backslashes).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Character classes (bodies and bracketed forms).
W_BODY = r"\p{L}\p{N}_"
W = f"[{W_BODY}]"
WS_BODY = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
WS = f"[{WS_BODY}]"
NOT_WS = f"[^{WS_BODY}]"
D = r"\p{Nd}"
NOT_D = r"\P{Nd}"
# ``str.splitlines`` breaks on these (CRLF counts once).
LINE_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# ``\b`` when the neighbouring pattern character may or may not be a word char.
BOUNDARY = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
# ``\b`` before / after a pattern character that is always a word char.
START = f"(?<!{W})"
END = f"(?!{W})"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_text(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A column's name in Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------------------
# Lines, stripping, counting
# ---------------------------------------------------------------------------
BREAK_CHARS = r"\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}"
OTHER_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"      # all but LF
# The characters of ``WS``.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                             0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _drop_final_break(c: Column) -> Column:
    """The text without one final line break; the pattern is tried only where the last character is one."""
    return F.when(F.right(c, F.lit(1)).rlike(f"[{BREAK_CHARS}]"), F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", "")).otherwise(c)


def has_other_break(c: Column) -> Column:
    """Whether the text holds a line break that is not LF (searches for fixed strings: a pattern
    tries its class at every character and takes several times as long)."""
    return functools.reduce(operator.or_, [c.contains(b) for b in OTHER_BREAKS])


def split_lines(c: Column, limit: int = -1, other: Column | None = None) -> Column:
    """Split at line breaks; texts with LF as their only line break are split without a pattern.
    ``other``: :func:`has_other_break` if it is known (true is always right)."""
    return F.when(has_other_break(c) if other is None else other, F.split(c, LINE_BREAK, limit)).otherwise(F.split(c, "\n", limit))


def split_break_chars(c: Column) -> Column:
    """The same with CR LF as two breaks, an empty line between them."""
    return F.when(has_other_break(c), F.split(c, f"[{BREAK_CHARS}]", -1)).otherwise(F.split(c, "\n", -1))


def splitlines(text: Column | str) -> Column:
    """``str.splitlines()``: one final line break is dropped first, so there is
    no trailing empty element; '' -> []."""
    c = col(text)
    parts = let(_drop_final_break(c), lambda t: split_lines(t))
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(parts)


def join_lines(text: Column | str, other: Column | None = None) -> Column:
    """``"\\n".join(text.splitlines())`` without materializing the lines; texts with LF as their
    only line break are not rewritten. ``other`` as in :func:`split_lines`."""
    c = _drop_final_break(col(text))
    return let(c, lambda t: F.when(has_other_break(t) if other is None else other, F.regexp_replace(t, LINE_BREAK, "\n")).otherwise(t))


def nonblank_lines(text: Column | str) -> Column:
    """Lines holding a non-whitespace character, unstripped, in order (a split is ten times
    as fast as extracting runs of other characters)."""
    return F.filter(split_break_chars(col(text)), lambda l: l.rlike(NOT_WS))


def strip(text: Column | str) -> Column:
    """``str.strip()`` with Unicode whitespace."""
    return F.btrim(col(text), F.lit(WS_CHARS))


def collapse_ws(text: Column | str) -> Column:
    """``re.sub(r"\\s+", " ", text)``."""
    return F.regexp_replace(col(text), f"{WS}+", " ")


def word_count(text: Column | str) -> Column:
    """``len(text.split())``."""
    return F.coalesce(F.regexp_count(col(text), F.lit(f"{NOT_WS}+")), F.lit(0)).cast("int")


def char_count(text: Column | str) -> Column:
    """``len(text)`` in code points."""
    return F.length(col(text))


def clean_text(text: Column | str) -> Column:
    """Extraction clean-up: NBSP -> space, drop ZWSP, per line collapse runs of
    space/tab and strip, drop empty lines, join with LF."""
    t = F.replace(F.replace(col(text), F.lit("\xa0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    lines = F.transform(splitlines(t), lambda l: strip(F.when(
        l.contains("  ") | l.contains("\t"), F.regexp_replace(l, "[ \t]+", " ")).otherwise(l)))
    return F.array_join(F.filter(lines, lambda l: l != F.lit("")), "\n")


def nonblank_stripped_lines(text: Column | str) -> Column:
    """``[l.strip() for l in text.splitlines() if l.strip()]`` (the empty line that a split
    leaves between CR and LF is dropped like any other)."""
    return F.filter(F.transform(split_break_chars(col(text)), strip), lambda l: l != F.lit(""))


# ---------------------------------------------------------------------------
# Case folding and Unicode normalization
# ---------------------------------------------------------------------------
def _fold_to_ascii_letters() -> tuple[tuple[str, str], ...]:
    """Characters whose ``casefold()`` differs from ``lower()`` and yields an ASCII letter."""
    return tuple(fixed.FOLDS_TO_ASCII.items())


def casefold_ascii(text: Column | str) -> Column:
    """``lower`` plus the folds that produce ASCII letters (ß -> ss, ﬁ -> fi, ...).

    Exact for rules that afterwards look only at ASCII letters (headings,
    address words); full folding is :func:`normalize_text`.
    """
    low = F.lower(col(text))
    out = low
    for ch, folded in _fold_to_ascii_letters():
        out = F.replace(out, F.lit(ch), F.lit(folded))
    return F.when(is_ascii(text), low).otherwise(out)


@functools.cache
def _nfkc_udf():
    # Defined inside so it is shipped by value: executors need no copy of
    # this package on their path.
    def nfkc_casefold(arr: pa.Array) -> pa.Array:
        import unicodedata as ud

        import pyarrow as pa_
        return pa_.array([None if v is None else ud.normalize("NFKC", v).casefold()
                          for v in arr.to_pylist()], type=pa_.string())

    return F.arrow_udf(nfkc_casefold, "string")


def is_ascii(text: Column | str) -> Column:
    c = col(text)
    return F.length(c) == F.octet_length(c)


def normalize_text(text: Column | str) -> Column:
    """``unicodedata.normalize("NFKC", text).casefold()``.

    ASCII rows (the vast majority) stay JVM-side: for them the result is
    ``lower``. Only non-ASCII rows are shipped to the Arrow UDF; ASCII rows
    reach it as nulls, which cost nothing to transfer.
    """
    c = col(text)
    return F.coalesce(_nfkc_udf()(F.when(~is_ascii(c), c)), F.lower(c))


def normalize_heading(line: Column) -> Column:
    """casefold, strip, keep only ``[a-z\\s]``, collapse whitespace, strip."""
    t = strip(casefold_ascii(line))
    t = F.regexp_replace(t, f"[^a-z{WS_BODY}]", "")
    return strip(collapse_ws(t))


# ---------------------------------------------------------------------------
# Scorecard predicates
# ---------------------------------------------------------------------------
EMAIL_CORE = fixed.EMAIL_CORE
# The cheapest tests first: no start within an ASCII word, then none whose run of address characters
# does not end at "@"; the Unicode boundary is looked at for what is left.
EMAIL = f"(?:(?<![A-Za-z0-9_])|(?=[.%+-]))(?=[A-Za-z0-9._%+-]++@){BOUNDARY}{EMAIL_CORE}{END}"


def has_email(text: Column | str) -> Column:
    return col(text).contains("@") & col(text).rlike(EMAIL)


def has_phone(text: Column | str) -> Column:
    """Ten to thirteen digits, each optionally followed by separators; every
    such run holds 10-13 digits, so existence of ten is the whole rule."""
    return col(text).rlike(rf"(?:{D}[{WS_BODY}().-]*){{10}}")


def has_profile_link(text: Column | str) -> Column:
    # one of the pattern's first letters (none has a non-ASCII form), tested before the alternatives
    return col(text).rlike(f"(?=[lghpwLGHPW])(?:{fixed.PROFILE_LINK})")


YEAR = f"(?=[12]){START}(?:19|20){D}{{2}}{END}"


def date_count(text: Column | str) -> Column:
    """Number of non-overlapping dates: a year, with a month name before it or without.

    Every match holds exactly one year token, and every year token (a
    4-digit 19xx/20xx run between non-word characters) lies in exactly one
    match -- the month form only adds the month in front. So the count
    equals the number of year tokens, found without trying twelve
    case-insensitive month alternatives at every character.
    """
    c = col(text)
    n = F.coalesce(F.regexp_count(c, F.lit(YEAR)), F.lit(0)).cast("int")
    return F.when(c.contains("19") | c.contains("20"), n).otherwise(F.lit(0))


def _allowed_class() -> str:
    escaped = "".join("\\" + ch if not ch.isalnum() else ch for ch in fixed.ALLOWED_SYMBOLS
                      if ord(ch) < 128)
    escaped += "".join(ch for ch in fixed.ALLOWED_SYMBOLS if ord(ch) >= 128)
    return escaped


def unusual_ratio(text: Column | str) -> Column:
    """Share of characters that are neither alphanumeric, whitespace nor an
    allowed symbol; 1.0 for the empty text."""
    c = col(text)
    # the letters and digits are a class of their own, tried before the rest
    unusual = F.length(F.regexp_replace(c, f"[[\\p{{L}}\\p{{N}}][{WS_BODY}{_allowed_class()}]]+", ""))
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(unusual / F.length(c))


# ---------------------------------------------------------------------------
# Numbers
# ---------------------------------------------------------------------------
_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitter


def py_round2(x: Column | str) -> Column:
    """Python ``round(x, 2)`` (half-even on the exact binary value).

    ``bround`` rounds the shortest decimal repr instead, which differs on
    ties such as 2.675. Here ``100*x`` is computed exactly as ``p + e``
    (error-free product), so ties are decided on the true value.
    """
    x = col(x)
    p = x * F.lit(100.0)
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    lo = x - hi
    e = (hi * F.lit(100.0) - p) + lo * F.lit(100.0)
    n = F.floor(p).cast("double")
    f = p - n
    up = (F.when(f > 0.5, 1).when(f < 0.5, 0).when(e > 0, 1).when(e < 0, 0)
          .when(F.pmod(n, F.lit(2.0)) == 0, 0).otherwise(1))
    return (n + up.cast("double")) / F.lit(100.0)


def py_round_int(x: Column | str) -> Column:
    """Python ``round(x)`` to an integer (half-even); x.5 is exact in binary."""
    return F.bround(col(x), 0).cast("long")
