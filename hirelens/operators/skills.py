"""Skill detection (catalog x text) and skill-set algebra.

A catalog is a plain ``{canonical name: [aliases]}`` mapping, as in the
reference; it is turned into one boolean expression per skill at plan
time, so detection is a narrow projection evaluated once per document
(never per pair) inside whole-stage codegen.
"""

from __future__ import annotations

import functools
import operator
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import normalize_text, py_round2, sql_name, sql_text

# An alias counts only when not glued to a word character, '+' or '#'.
_EDGE = r"[\p{L}\p{N}_+#]"


def _norm(s: str) -> str:
    return unicodedata.normalize("NFKC", s).casefold()


def _quote(s: str) -> str:
    return r"\Q" + s + r"\E" if r"\E" not in s else "".join("\\" + c if not c.isalnum() else c for c in s)


def alias_pattern(aliases: list[str]) -> str:
    """One alternation per skill: a match exists iff some alias matches
    on its own (look-arounds are retried for every alternative). The first character is tested
    first: the look-behind takes several times as long and is left out at most positions."""
    alts = "|".join(_quote(a) for a in aliases)
    first = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({a[0] for a in aliases}))
    return f"(?=[{first}])(?<!{_EDGE})(?:{alts})(?!{_EDGE})"


def _shortest(aliases: list[str]) -> list[str]:
    """The aliases that hold no other one: a text with any alias has one of these."""
    return [a for a in dict.fromkeys(aliases) if not any(b != a and b in a for b in aliases)]


def skill_present(norm_text: Column, aliases: list[str]) -> Column:
    """Cheap ``contains`` prefilter first; the regex runs only on candidates."""
    pre = functools.reduce(operator.or_, [norm_text.contains(a) for a in _shortest(aliases)])
    return pre & norm_text.rlike(alias_pattern(aliases))


def find_skills(norm_text: Column | str, catalog: dict[str, list[str]]) -> Column:
    """Sorted canonical names of the skills found in an already normalized text.

    For a named column one SQL expression is parsed: building it from hundreds of Column
    calls takes longer than most queries' work. The optimizer may put the column's expression in place
    of its name, so it is bound by a lambda: else a text would be folded again for every alias."""
    catalog = {name: [_norm(a) for a in own if a] for name, own in catalog.items()}
    catalog = {name: own for name, own in catalog.items() if own}
    if not catalog:
        return F.array().cast("array<string>")
    if isinstance(norm_text, Column):
        hits = [F.when(skill_present(norm_text, own), F.lit(name)) for name, own in catalog.items()]
        return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    text = "norm_text"
    hits = []
    for name, own in catalog.items():
        near = " OR ".join(f"contains({text}, {sql_text(a)})" for a in _shortest(own))
        hits.append(f"CASE WHEN ({near}) AND {text} RLIKE {sql_text(alias_pattern(own))} THEN {sql_text(name)} END")
    found = f"array_sort(filter(array({', '.join(hits)}), x -> x IS NOT NULL))"
    return F.expr(f"element_at(transform(array({sql_name(norm_text)}), {text} -> {found}), 1)")


def with_skills(df, text_col: str, prefix: str = "",
                technical: dict[str, list[str]] | None = None,
                soft: dict[str, list[str]] | None = None):
    """Add ``{prefix}technical_skills`` and ``{prefix}soft_skills``.

    The normalized text is materialized in its own projection so the
    optimizer does not inline the (UDF-backed) normalization into every one
    of the ~50 skill predicates.
    """
    technical = fixed.TECHNICAL_SKILLS if technical is None else technical
    soft = fixed.SOFT_SKILLS if soft is None else soft
    norm = f"__norm_{prefix}"
    out = df.withColumn(norm, normalize_text(text_col))
    return out.withColumns({f"{prefix}technical_skills": find_skills(norm, technical),
                            f"{prefix}soft_skills": find_skills(norm, soft)}).drop(norm)


def match_percentage(required: Column, present: Column) -> Column:
    """``round(|R ∩ S| / |R| * 100, 2)``, 0.0 when nothing is required."""
    req = F.array_distinct(required)
    hit = F.size(F.array_intersect(req, F.array_distinct(present)))
    return F.when(F.size(req) == 0, F.lit(0.0)).otherwise(
        py_round2(hit.cast("double") / F.size(req).cast("double") * F.lit(100.0)))


def matched(required: Column, present: Column) -> Column:
    return F.array_sort(F.array_intersect(required, present))


def missing(required: Column, present: Column) -> Column:
    return F.array_sort(F.array_except(required, present))
