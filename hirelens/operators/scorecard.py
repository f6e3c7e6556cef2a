"""Readability scorecard: section detection and the fourteen rule checks.

Everything is a narrow projection (one row in, one row out), so the
scorecard of a table costs one scan and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (date_count, has_email, has_phone, has_profile_link,
                              nonblank_stripped_lines, normalize_heading, unusual_ratio, word_count)



def heading_lines(text: Column | str) -> Column:
    """Normalized lines whose stripped length is 1..50 (normalization strips
    first, so starting from the stripped lines changes nothing; long lines
    are dropped before the costly normalization)."""
    return short_headings(nonblank_stripped_lines(text))


def short_headings(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda l: F.length(l) <= 50), normalize_heading)


def find_sections(text: Column | str) -> Column:
    """``struct<summary, skills, experience, education, projects, certifications: boolean>``."""
    return sections_from_headings(heading_lines(text))


def sections_from_headings(lines: Column) -> Column:
    return F.struct(*[
        F.arrays_overlap(lines, F.array(*[F.lit(a) for a in aliases])).alias(name)
        for name, aliases in fixed.SECTION_ALIASES.items()
    ])


def _check(name: str, points: Column, maximum: int, message: Column) -> Column:
    p = points.cast("int")
    return F.struct(F.lit(name).alias("name"), p.alias("points"),
                    F.lit(maximum).alias("maximum"), (p == F.lit(maximum)).alias("passed"),
                    message.alias("message"))


def _flag(name: str, found: Column, points: int, yes: str, no: str) -> Column:
    return _check(name, F.when(found, points).otherwise(0), points,
                  F.when(found, F.lit(yes)).otherwise(F.lit(no)))


def _ladder(branches: list[tuple[Column | None, int, str]]) -> tuple[Column, Column]:
    """CASE ladder: [(condition, points, message), ..., (None, points, message)]."""
    pts = msg = None
    for cond, p, m in branches:
        if cond is None:
            pts, msg = pts.otherwise(p), msg.otherwise(F.lit(m))
        elif pts is None:
            pts, msg = F.when(cond, p), F.when(cond, F.lit(m))
        else:
            pts, msg = pts.when(cond, p), msg.when(cond, F.lit(m))
    return pts, msg


def checks(words: Column, sections: Column, email: Column, phone: Column, link: Column,
           dates: Column, extension: Column, ratio: Column, n_lines: Column,
           longest: Column) -> Column:
    """The fourteen checks, in order, as ``array<struct<name, points, maximum, passed, message>>``."""
    m = fixed.MSG
    out = []
    p, msg = _ladder([(words >= 100, 20, m["parse_20"]), (words >= 50, 10, m["parse_10"]),
                      (None, 0, m["parse_0"])])
    out.append(_check("Text parseability", p, 20, msg))
    out.append(_flag("Email address", email, 7, m["email_yes"], m["email_no"]))
    out.append(_flag("Phone number", phone, 6, m["phone_yes"], m["phone_no"]))
    out.append(_flag("Professional link", link, 2, m["link_yes"], m["link_no"]))
    for name, pts in fixed.SECTION_POINTS:
        title = name.title()
        out.append(_flag(f"{title} section", sections[name], pts,
                         m["section_yes"].format(name=name), m["section_no"].format(title=title)))
    optional = sections["projects"] | sections["certifications"]
    out.append(_flag("Projects or certifications", optional, 4, m["optional_yes"], m["optional_no"]))
    p, msg = _ladder([(dates >= 2, 10, m["dates_2"]), (dates == 1, 5, m["dates_1"]),
                      (None, 0, m["dates_0"])])
    out.append(_check("Dates and chronology", p, 10, msg))
    p, msg = _ladder([(words.between(250, 1000), 10, m["length_10"]),
                      (words.between(150, 1500), 7, m["length_7"]), (None, 3, m["length_3"])])
    out.append(_check("Resume length", p, 10, msg))
    supported = F.lower(extension).isin(*fixed.SUPPORTED_EXTENSIONS)
    out.append(_check("File format", F.when(supported, 5).otherwise(0), 5,
                      F.when(supported, F.concat(F.upper(extension), F.lit(" is a supported format.")))
                       .otherwise(F.lit(m["format_no"]))))
    p, msg = _ladder([(ratio <= 0.01, 5, m["chars_5"]), (ratio <= 0.03, 3, m["chars_3"]),
                      (None, 0, m["chars_0"])])
    out.append(_check("Character readability", p, 5, msg))
    p, msg = _ladder([((n_lines >= 8) & (longest <= 300), 5, m["structure_5"]),
                      (n_lines >= 4, 3, m["structure_3"]), (None, 0, m["structure_0"])])
    out.append(_check("Text structure", p, 5, msg))
    return F.array(*out)


def rating(score: Column) -> Column:
    out = None
    for threshold, label in fixed.RATINGS:
        out = F.when(score >= threshold, label) if out is None else out.when(score >= threshold, label)
    return out.otherwise(fixed.RATING_FLOOR)


def scorecard(df: DataFrame, text_col: str = "text", filename_col: str = "filename",
              extension_col: str = "extension", keep: list[str] | None = None,
              words: Column | None = None) -> DataFrame:
    """Add the scorecard columns: ``score, rating, checks, sections,
    missing_sections, word_count`` (plus ``filename``) to every row.

    Per-row features are computed in one projection and reused, so each
    regex scans the text once. ``words``: the text's word count if it is known.
    """
    keep = keep if keep is not None else [c for c in df.columns]
    base = df.select(
        *keep,
        (word_count(text_col) if words is None else words).alias("word_count"),
        nonblank_stripped_lines(text_col).alias("_lines"),
        has_email(text_col).alias("_email"),
        has_phone(text_col).alias("_phone"),
        has_profile_link(text_col).alias("_link"),
        date_count(text_col).alias("_dates"),
        unusual_ratio(text_col).alias("_ratio"),
    )
    lines = F.col("_lines")
    feats = (base.withColumn("_heads", short_headings(lines))
                 .withColumn("sections", sections_from_headings(F.col("_heads")))
                 .withColumn("_n_lines", F.size(lines))
                 .withColumn("_longest", F.coalesce(F.array_max(F.transform(lines, lambda l: F.length(l))),
                                                    F.lit(0)))
                 .drop("_heads", "_lines"))
    s = F.col("sections")
    with_checks = feats.withColumn("checks", checks(
        F.col("word_count"), s, F.col("_email"), F.col("_phone"), F.col("_link"),
        F.col("_dates"), F.col(extension_col), F.col("_ratio"), F.col("_n_lines"),
        F.col("_longest")))
    score = F.aggregate(F.col("checks"), F.lit(0), lambda acc, c: acc + c["points"])
    names = F.array(*[F.lit(n) for n in fixed.SECTION_NAMES])
    missing_sections = F.filter(names, lambda n: ~F.coalesce(
        F.element_at(_sections_map(s), n), F.lit(False)))
    return (with_checks.withColumn("score", score)
            .withColumn("rating", rating(F.col("score")))
            .withColumn("missing_sections", missing_sections)
            .drop("_email", "_phone", "_link", "_dates", "_ratio", "_n_lines", "_longest"))


def _sections_map(s: Column) -> Column:
    return F.create_map(*[x for n in fixed.SECTION_NAMES for x in (F.lit(n), s[n])])


def section_lists(s: Column) -> tuple[Column, Column]:
    """Title-cased found and missing section names, catalog order."""
    names = F.array(*[F.lit(n) for n in fixed.SECTION_NAMES])
    m = _sections_map(s)
    found = F.transform(F.filter(names, lambda n: F.element_at(m, n)), F.initcap)
    miss = F.transform(F.filter(names, lambda n: ~F.element_at(m, n)), F.initcap)
    return found, miss


def recommendations(checks_col: Column) -> Column:
    """Messages of the checks that did not pass, in check order."""
    failed = F.filter(checks_col, lambda c: ~c["passed"] & (c["message"] != F.lit("")))
    return F.transform(failed, lambda c: c["message"])


def check_rows(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Long form: one row per check with 1-based ordinal, icon and points label."""
    out = df.select(*id_cols, F.posexplode("checks").alias("pos", "c"))
    return out.select(
        *id_cols, (F.col("pos") + 1).alias("check_no"),
        F.col("c.name").alias("name"), F.col("c.points").alias("points"),
        F.col("c.maximum").alias("maximum"), F.col("c.passed").alias("passed"),
        F.col("c.message").alias("message"),
        F.when(F.col("c.passed"), F.lit(fixed.CHECK_ICON_PASSED))
         .otherwise(F.lit(fixed.CHECK_ICON_FAILED)).alias("icon"),
        F.format_string("%d/%d", F.col("c.points"), F.col("c.maximum")).alias("points_label"))
