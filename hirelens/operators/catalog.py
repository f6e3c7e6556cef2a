"""Skill detection with a catalog that is a table: a phrase index join.

:func:`~hirelens.operators.skills.find_skills` makes one regex per skill of a
Python mapping at plan time, which suits the fixed catalogs. A catalog of any
size is a table ``(family, skill, alias)`` here, and never part of the plan:

* an alias is split into the words it spans and what it has before and after
  them (``c++`` is ``c`` and then ``++``; ``.net`` is ``.`` and then ``net``);
  the part from its first to its last word is the key of the index;
* a text is cut into runs of word characters and of others; from every word that
  begins some key, the next characters, as many as such keys have, are looked up by an
  equi-join on the key, and the neighbouring characters decide whether the alias stands
  there by itself (a key that ends within a word has a word character behind it);
* an alias without any word character is looked up among the slices of the
  runs of other characters.

The rule is the same as that of ``find_skills``: an alias counts where it is not
glued to a word character, ``+`` or ``#``, after NFKC and case folding of both.

The index is broadcast if its measured size allows; else phrases are exchanged by
key, where a frequent phrase is split by AQE's skew join (an index key holds
few aliases). Nothing but the lengths of aliases reaches the driver.

Defined results: null and blank aliases count for nothing; repeated catalog
rows count once; a null or empty text has no skills; ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import W, W_BODY, col, normalize_text
from ..session import is_small, keep

_OTHER = f"[^{W_BODY}]"
_EDGE = f"[{W_BODY}+#]"
_WORD = "a"                     # stands for the word next to a run


def catalog_table(spark: SparkSession, family: str, catalog: dict[str, list[str]]) -> DataFrame:
    """A Python mapping as catalog rows."""
    return spark.createDataFrame([(family, s, a) for s, own in catalog.items() for a in own], "family string, skill string, alias string")


def alias_index(catalog: DataFrame) -> DataFrame:
    """The stored index ``(family, skill, key, lead, trail, words, length)`` of a catalog table."""
    a = catalog.select("family", "skill", normalize_text("alias").alias("a")).where("a IS NOT NULL AND a <> ''").distinct()
    words = F.coalesce(F.regexp_count("a", F.lit(f"{W}+")), F.lit(0))
    core = F.regexp_extract("a", rf"(?s)\A{_OTHER}*({W}(?:.*{W})?){_OTHER}*\z", 1)
    x = a.select("family", "skill", "a", words.alias("words"), core.alias("core"))
    some = F.col("words") > 0
    return keep(x.select(
        "family", "skill", F.when(some, F.col("core")).otherwise(F.col("a")).alias("key"),
        F.when(some, F.regexp_extract("a", rf"(?s)\A({_OTHER}*)", 1)).otherwise("").alias("lead"),
        F.when(some, F.regexp_extract("a", rf"(?s)({_OTHER}*)\z", 1)).otherwise("").alias("trail"),
        "words", F.length("a").alias("length")), "alias-index")


def _starts(text: Column, first: Column, words: int, chars: int, reach: int) -> Column:
    """``array<struct<first, before, ahead>>``: every word with what stands before it and, itself
    included, the next characters: of ``words`` words and the runs behind each, ``chars`` at most."""
    n = F.size(text)
    none = F.array().cast("array<struct<first: string, before: string, ahead: string>>")

    def at(i: Column) -> Column:
        before = F.when(i > 1, F.concat(F.when(i > 2, _WORD).otherwise(""), F.element_at(text, i - 1))).otherwise("")
        return F.struct(F.element_at(text, i).alias("first"), F.right(before, F.lit(reach)).alias("before"),
                        F.left(F.array_join(F.slice(text, i, 2 * words + 1), ""), F.lit(chars)).alias("ahead"))

    return F.when(n >= first, F.transform(F.sequence(first, n, F.lit(2)), at)).otherwise(none)


def _slices(text: Column, first: Column, lengths: list[int]) -> Column:
    """The same for every slice of the given lengths of the runs without word characters."""
    n = F.size(text)
    start = F.when(first == 1, 2).otherwise(1)
    none = F.array().cast("array<struct<key: string, before: string, after: string>>")

    def run(i: Column) -> Column:
        s = F.concat(F.when(i > 1, _WORD).otherwise(""), F.element_at(text, i), F.when(i < n, _WORD).otherwise(""))
        def every(k: int) -> Column:
            return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda p: F.struct(
                F.substring(s, p, F.lit(k)).alias("key"), F.when(p > 1, F.substring(s, p - 1, F.lit(1))).otherwise("").alias("before"),
                F.substring(s, p + k, F.lit(1)).alias("after")))).otherwise(none)

        return F.concat(*[every(k) for k in lengths])

    return F.when(n >= start, F.flatten(F.transform(F.sequence(start, n, F.lit(2)), run))).otherwise(none)


def _stands_alone(before: Column, after: Column, lead: Column, trail: Column) -> Column:
    """Lead and trail are there, and next to them no character that would glue the alias on."""
    left = F.left(before, F.length(before) - F.length(lead))
    right = F.right(after, F.length(after) - F.length(trail))
    return (before.endswith(lead) & after.startswith(trail)
            & ~F.right(left, F.lit(1)).rlike(_EDGE) & ~F.left(right, F.lit(1)).rlike(_EDGE))


def find_catalog_skills(docs: DataFrame, id_col: str, text_col: str, index: DataFrame,
                        families: list[str]) -> DataFrame:
    """``(id_col, {family}_skills, ...)``: per document the sorted names of each family's skills found.

    ``index`` is a stored :func:`alias_index`; every document keeps its row."""
    some = F.col("words") > 0
    sizes = index.agg(F.coalesce(F.max(F.when(some, F.col("words"))), F.lit(0)).alias("words"),
                      F.coalesce(F.max(F.length("key")), F.lit(0)).alias("chars"),
                      F.collect_set(F.when(~some, F.col("length"))).alias("lengths"),
                      F.max(F.greatest(F.length("lead"), F.length("trail"))).alias("reach")).first()
    reach = (sizes.reach or 0) + 1
    runs = F.when(F.col("__t") != "", F.regexp_extract_all("__t", F.lit(f"{W}+|{_OTHER}+"), 0))
    text = docs.select(col(id_col), normalize_text(text_col).alias("__t")).select(
        id_col, runs.alias("__r"), F.when(F.col("__t").rlike(rf"\A{W}"), 1).otherwise(2).alias("__f"))
    found = _starts(F.col("__r"), F.col("__f"), sizes.words, sizes.chars + reach, reach)
    if sizes.lengths:
        found = F.concat(found, F.transform(_slices(F.col("__r"), F.col("__f"), sorted(sizes.lengths)), lambda x: F.struct(
            x["key"].alias("first"), x["before"].alias("before"), F.concat(x["key"], x["after"]).alias("ahead"))))
    starts = text.where("__r IS NOT NULL").select(id_col, F.explode(found).alias("p")).select(id_col, "p.*")
    hint = F.broadcast if is_small(index) else lambda x: x
    # a word is followed up only if a key begins with it, by one row for each length of such keys
    firsts = index.select(F.when(some, F.regexp_extract("key", rf"\A({W}+)", 1)).otherwise(F.col("key")).alias("first"),
                          F.length("key").alias("chars")).distinct()
    rest = F.col("chars") + 1
    phrases = starts.join(hint(firsts), "first").select(
        id_col, F.left("ahead", F.col("chars")).alias("key"), "before", F.substring("ahead", rest, F.lit(reach)).alias("after"))
    keys = hint(index)
    hits = phrases.join(keys, "key").where(_stands_alone(*map(F.col, ("before", "after", "lead", "trail"))))
    sets = [F.array_sort(F.collect_set(F.when(F.col("family") == f, F.col("skill")))).alias(f"{f}_skills") for f in families]
    per_doc = hits.groupBy(id_col).agg(*sets)
    none = F.array().cast("array<string>")
    return docs.select(id_col).join(per_doc, id_col, "left").select(
        id_col, *[F.coalesce(f"{f}_skills", none).alias(f"{f}_skills") for f in families])
