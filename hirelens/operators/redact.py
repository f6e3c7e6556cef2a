"""Personal-information redaction: eight ordered passes with counts.

Each pass reads the previous pass's output, so the chain is a sequence of
projections (``withColumns``); every pass is a JVM regex over one row --
no shuffle, no Python. Patterns follow the reference's Python ``re``
semantics with explicit Unicode classes (see ``functions.text``).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (D, END, NOT_D, NOT_WS, START, WS,
                              EMAIL,
                              casefold_ascii, col, collapse_ws, has_other_break, join_lines, let, nonblank_lines,
                              split_lines, splitlines, strip)

# Patterns begin with what their first character must be, so most positions fail at one cheap test.
# (Without regard to case h, w, l and g are these eight characters only.)
URL = (rf"(?iu)(?=[hwlgHWLG])(?:{START}(?:https?://|www\.){NOT_WS}+"
       rf"|{START}(?:linkedin\.com|github\.com)/{NOT_WS}+)")
AADHAAR = f"(?<!{D}){D}{{4}}{WS}?{D}{{4}}{WS}?{D}{{4}}(?!{D})"
# Python's case-insensitive [A-Z] also accepts these four non-ASCII letters.
_LETTER_I = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
PAN = f"{START}{_LETTER_I}{{5}}[0-9]{{4}}{_LETTER_I}{END}"
_PHONE_BODY = rf"{D}[{D} ().-]{{8,}}{D}"
PHONE_CANDIDATE = rf"(?=[+{D}])(?<!{D})(?:\+?{_PHONE_BODY})(?!{D})"
PIN = f"(?=[1-9]){START}[1-9][0-9]{{5}}{END}"
# What every text with a match holds; found by its digits, without looking behind each character.
_AADHAAR_NEEDS = f"{D}{{4}}{WS}?{D}{{4}}{WS}?{D}{{4}}"
_PAN_NEEDS = f"[0-9]{{4}}{_LETTER_I}"
SENSITIVE = (rf"(?iu)\A{WS}*(?:" + "|".join(fixed.SENSITIVE_LABELS) + rf"){WS}*[:\-]")
NAME_SHAPE = r"\A[A-Za-z][A-Za-z .'’-]+\z"


_HEAD_SPLIT = 32


def _first_nonblank_lines(text: Column, k: int, other: Column | None) -> Column:
    """The first ``k`` non-blank lines (unstripped). Only the first 32 lines
    are split off; the whole text is scanned only when those hold fewer than
    ``k`` non-blank lines and more lines follow."""
    def first(parts: Column) -> Column:
        def of_head(head: Column) -> Column:
            enough = (F.size(head) >= k) | (F.size(parts) <= _HEAD_SPLIT)
            return F.when(enough, F.slice(head, 1, k)).otherwise(F.slice(nonblank_lines(text), 1, k))

        return let(F.filter(F.slice(parts, 1, _HEAD_SPLIT), lambda l: l.rlike(NOT_WS)), of_head)

    return let(split_lines(text, _HEAD_SPLIT + 1, other), first)


def detect_candidate_name(text: Column | str, other: Column | None = None) -> Column:
    """First of the first four non-blank lines that looks like a person's name
    (whitespace collapsed), else null. ``other`` as in ``split_lines``."""
    header = _first_nonblank_lines(col(text), fixed.HEADER_NAME_LINES, other)
    cands = F.transform(header, lambda l: collapse_ws(strip(l)))

    def looks_like_name(n: Column) -> Column:
        low = F.lower(n)
        words = F.split(n, " ")
        return (~low.isin(*fixed.NAME_EXCLUSIONS)
                & ~F.arrays_overlap(F.split(low, " "), F.array(*[F.lit(w) for w in fixed.ROLE_WORDS]))
                & ~n.contains("@")
                & ~n.rlike(D)
                & n.rlike(NAME_SHAPE)
                & F.size(words).between(2, 5)
                & (~n.rlike("[a-z]")
                   | F.forall(words, lambda w: F.substring(w, 1, 1).rlike("[A-Z]"))))

    return F.try_element_at(F.filter(cands, looks_like_name), F.lit(1))


def _count(text: Column, pattern: str | Column) -> Column:
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.coalesce(F.regexp_count(text, p), F.lit(0)).cast("int")


def name_pieces(text: Column, name: Column) -> Column:
    """The text split at the name, in any letter case; null without a name. A name is a pattern of
    its row, so one split serves the count and the new text."""
    return F.split(text, F.concat(F.lit(r"(?iu)\Q"), name, F.lit(r"\E")), -1)


def redact_name(text: Column, pieces: Column) -> tuple[Column, Column]:
    """From :func:`name_pieces`."""
    return (F.coalesce(F.array_join(pieces, fixed.TOKENS["name"]), text),
            F.coalesce(F.size(pieces) - 1, F.lit(0)))


def redact_pattern(text: Column, pattern: str, token: str,
                   needs: str | Column | None = None) -> tuple[Column, Column]:
    """Replace every match and count them. ``needs`` is a substring every
    match contains (or a cheaper predicate every matching text satisfies),
    checked first so most texts skip both regex scans."""
    out, cnt = F.regexp_replace(text, pattern, token), _count(text, pattern)
    if needs is None:
        return out, cnt
    has = text.contains(needs) if isinstance(needs, str) else needs
    return F.when(has, out).otherwise(text), F.when(has, cnt).otherwise(F.lit(0))


def _url_possible(text: Column) -> Column:
    # Every URL match holds "://", or "www." / "linkedin.com/" / "github.com/"
    # in any letter case; lower-casing keeps ASCII letters' positions.
    low = F.lower(text)
    return text.contains("://") | low.contains("www.") | low.contains(".com/")


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, NOT_D, ""))


def _line_matches(text: Column, pattern: str, near) -> Column:
    """All matches of a pattern that takes no LF, looked for only in the lines that ``near`` accepts
    (no look-around tells an LF from the text's end)."""
    lines = F.filter(F.split(text, "\n", -1), near)
    return F.flatten(F.transform(lines, lambda l: F.regexp_extract_all(l, F.lit(pattern), 0)))


def _each_line(text: Column, near, fn) -> Column:
    """``fn`` of the lines that ``near`` accepts, the others as they are."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda l: F.when(near(l), fn(l)).otherwise(l)), "\n")


def redact_emails(text: Column) -> tuple[Column, Column]:
    def near(line: Column) -> Column:
        return line.contains("@")

    has = near(text)
    out = _each_line(text, near, lambda l: F.regexp_replace(l, EMAIL, fixed.TOKENS["email"]))
    cnt = F.size(_line_matches(text, EMAIL, near)).cast("int")
    return F.when(has, out).otherwise(text), F.when(has, cnt).otherwise(F.lit(0))


def _is_phone(candidate: Column) -> Column:
    return _digits(candidate).between(10, 13)


def _phone_line(line: Column) -> Column:
    """``split`` and ``regexp_extract_all`` walk the same matches, so the line is
    rebuilt as piece₀ + r₁ + piece₁ + ... with each rᵢ decided per match."""
    pieces = F.split(line, PHONE_CANDIDATE, -1)
    found = F.regexp_extract_all(line, F.lit(PHONE_CANDIDATE), 0)
    repl = F.transform(found, lambda m: F.when(_is_phone(m), F.lit(fixed.TOKENS["phone"])).otherwise(m))
    return F.array_join(F.zip_with(pieces, F.concat(repl, F.array(F.lit(""))), lambda p, r: F.concat(p, r)), "")


def redact_phone_numbers(text: Column) -> tuple[Column, Column]:
    """Candidates are replaced only when they hold 10..13 digits; others stay whole."""
    def near(line: Column) -> Column:
        return line.rlike(_PHONE_BODY)

    return (_each_line(text, near, _phone_line),
            F.size(F.filter(_line_matches(text, PHONE_CANDIDATE, near), _is_phone)).cast("int"))


def _when_phone(text: Column, fn) -> tuple[Column, Column]:
    """Texts without a run of digits and separators as long as a phone candidate keep as they are."""
    out, cnt = fn(text)
    has = text.rlike(_PHONE_BODY)
    return F.when(has, out).otherwise(text), F.when(has, cnt).otherwise(F.lit(0))


def _address_line(line: Column) -> Column:
    """An address word as a substring of the case-folded line, or a postal code."""
    word = let(casefold_ascii(line), lambda low: functools.reduce(operator.or_, [low.contains(w) for w in fixed.ADDRESS_WORDS]))
    return word | line.rlike(PIN)


def redact_header_addresses(text: Column) -> tuple[Column, Column]:
    """Whole line -> token among the first twelve lines when it holds an address
    word (as a substring) or a six-digit postal code; lines rejoined with LF.

    Only the header is split into lines; the rest of the (line-end
    normalized) text is carried over as one string.
    """
    both = header_addresses(text)
    return both["text"], both["n"]


def header_addresses(text: Column, other: Column | None = None) -> Column:
    """:func:`redact_header_addresses` as one ``struct<text, n>``, worked out once. ``other`` as in
    ``split_lines``."""
    n = fixed.HEADER_ADDRESS_LINES

    def of_parts(parts: Column) -> Column:
        rest = F.element_at(parts, -1)                  # behind the header, or the last line
        longer = F.size(parts) > n
        # a final line break leaves an empty last part, which is no line
        ended = (F.size(parts) > 1) & (rest == F.lit(""))
        tail = F.when(longer & ~ended, F.concat(F.lit("\n"), join_lines(rest, other))).otherwise(F.lit(""))
        head = F.when(longer | ended, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        marked = F.transform(head, lambda l: F.when(_address_line(l), F.lit(fixed.TOKENS["address"])))
        return let(marked, lambda m: F.struct(
            F.concat(F.array_join(F.zip_with(head, m, lambda l, x: F.coalesce(x, l)), "\n"), tail).alias("text"),
            F.size(F.filter(m, lambda x: x.isNotNull())).cast("int").alias("n")))

    return F.when(text.isNotNull(), let(split_lines(text, n + 1, other), of_parts))


# Existence of a sensitive line in LF-only text with an LF put in front (the last LF before the
# label, then the rule; other whitespace may stand between).
_SENSITIVE_ANY = (r"(?iu)\n[\x09\x0b-\x0d\x1c-\x20\x{85}\p{Z}]*(?:" + "|".join(fixed.SENSITIVE_LABELS)
                  + rf"){WS}*[:\-]")


def _sensitive_possible(text: Column) -> Column:
    return F.concat(F.lit("\n"), text).rlike(_SENSITIVE_ANY)


def redact_sensitive_lines(text: Column, normalized: bool = False) -> tuple[Column, Column]:
    """Whole line -> token when it starts with a personal-field label.

    With ``normalized`` (the input already went through the address pass, so
    its lines are LF-joined) a single regex scan decides whether any line can
    match; texts without one only get the line re-join (which still drops a
    final empty line), done as one regex instead of split + join.
    """
    both = sensitive_lines(text)
    if not normalized:
        return both["text"], both["n"]
    any_hit = _sensitive_possible(text)
    return (F.when(any_hit, both["text"]).otherwise(join_lines(text)), F.when(any_hit, both["n"]).otherwise(F.lit(0)))


def sensitive_lines(text: Column) -> Column:
    """:func:`redact_sensitive_lines` as one ``struct<text, n>``, worked out once."""
    def hit(line: Column) -> Column:
        return (line.contains(":") | line.contains("-")) & line.rlike(SENSITIVE)

    def of_lines(lines: Column) -> Column:
        marked = F.transform(lines, lambda l: F.when(hit(l), F.lit(fixed.TOKENS["sensitive_fields"])))
        return let(marked, lambda m: F.struct(
            F.array_join(F.zip_with(lines, m, lambda l, x: F.coalesce(x, l)), "\n").alias("text"),
            F.size(F.filter(m, lambda x: x.isNotNull())).cast("int").alias("n")))

    return F.when(text.isNotNull(), let(splitlines(text), of_lines))


def redact(df: DataFrame, text_col: str = "text", out_col: str = "redacted_text") -> DataFrame:
    """Add ``redacted_text``, ``redactions`` (struct of eight counts),
    ``total_redactions`` and ``candidate_name_detected``."""
    t = "__t"
    # no pass adds a line break, so what the text itself lacks is looked for once
    other = F.col("__other")
    out = df.withColumns({"__other": has_other_break(col(text_col)), t: col(text_col)})
    out = out.withColumn("__name", detect_candidate_name(F.col(t), other))
    out = out.withColumn("__pieces", name_pieces(F.col(t), F.col("__name")))
    passes = [("name", lambda x: redact_name(x, F.col("__pieces"))),
              ("email", redact_emails),
              ("url", lambda x: redact_pattern(x, URL, fixed.TOKENS["url"], _url_possible(x))),
              ("aadhaar", lambda x: redact_pattern(x, AADHAAR, fixed.TOKENS["aadhaar"],
                                                   x.rlike(_AADHAAR_NEEDS))),
              ("pan", lambda x: redact_pattern(x, PAN, fixed.TOKENS["pan"], x.rlike(_PAN_NEEDS))),
              ("phone", lambda x: _when_phone(x, redact_phone_numbers))]
    for key, fn in passes:
        # counted first: only a text with a match is rewritten
        text, n = fn(F.col(t))
        out = out.withColumn(f"__c_{key}", n)
        out = out.withColumn(t, F.when(F.col(f"__c_{key}") > 0, text).otherwise(F.col(t)))
    out = out.withColumn("__h", header_addresses(F.col(t), other))
    out = out.withColumns({t: F.col("__h.text"), "__c_address": F.col("__h.n")}).drop("__h")
    any_hit = _sensitive_possible(F.col(t))
    out = out.withColumn("__s", F.when(any_hit, sensitive_lines(F.col(t))))
    out = out.withColumns({
        t: F.when(F.col("__s").isNotNull(), F.col("__s.text")).otherwise(join_lines(F.col(t), F.lit(False))),
        "__c_sensitive_fields": F.coalesce(F.col("__s.n"), F.lit(0))}).drop("__s")
    counts = F.struct(*[F.col(f"__c_{k}").alias(k) for k in fixed.REDACTION_KEYS])
    total = sum((F.col(f"__c_{k}") for k in fixed.REDACTION_KEYS[1:]), F.col("__c_name"))
    return (out.withColumn(out_col, F.col(t))
               .withColumn("redactions", counts)
               .withColumn("total_redactions", total.cast("int"))
               .withColumn("candidate_name_detected", F.col("__name").isNotNull())
               .drop(t, "__other", "__name", "__pieces", *[f"__c_{k}" for k in fixed.REDACTION_KEYS]))
