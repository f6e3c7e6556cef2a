"""Pairwise TF-IDF cosine similarity in closed form.

The reference fits a 1-2-gram TF-IDF model (smooth idf, l2 norm) on each
two-document pair. With only two documents the idf takes two values --
1 for a term in both, ``c = 1 + ln 1.5`` for a term in one -- so

    sim = dot / sqrt((c²·Sr + (1-c²)·rr) · (c²·Sj + (1-c²)·jj))

where ``dot, rr, jj`` are integer sums over the *shared* terms of the pair
and ``Sr, Sj`` are per-document sums of squared term counts. Everything
except the final expression is integer arithmetic, so the result does not
depend on summation order.

Plan shape (driven by the pair table, never by an all-pairs term join):

    terms per document       counted in the document's row; Σ tf² rides along on every term row
    resume_terms ⋉ job terms on term                (a job names few of all terms; broadcast if measured small)
    pairs ⋈ job_terms        on job_id              (|pairs| x terms per job)
          ⋈ resume_terms     on (resume_id, term)   (keeps shared terms only)
    → groupBy(resume_id, job_id) integer sums       (partial agg map-side)

The work is linear in Σ_pairs |terms(job)|; a frequent term never fans out
to all document pairs. A hot job key (one job in a third of all
applications) only affects the first join, whose skewed partitions AQE
splits; the second join is keyed by (resume_id, term), which spreads even a
hot résumé over its terms.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import W, py_round2, sql_name, sql_text

# idf of a term found in only one of the two documents, squared.
C2 = (1.0 + math.log(1.5)) ** 2
STOP_WORDS = list(fixed.ENGLISH_STOP_WORDS)
# Tokens counted together: the working memory of a Python worker, whatever a batch holds.
PART_TOKENS = 200_000


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters, stop words removed (for a named column one
    SQL expression is parsed: hundreds of literals made one by one take longer)."""
    if isinstance(text, str):
        stop = ", ".join(map(sql_text, STOP_WORDS))
        return F.expr(f"filter(regexp_extract_all(lower({sql_name(text)}), {sql_text(f'{W}{{2,}}')}, 0), x -> x NOT IN ({stop}))")
    toks = F.regexp_extract_all(F.lower(text), F.lit(f"{W}{{2,}}"), 0)
    return F.filter(toks, lambda t: ~t.isin(*STOP_WORDS))


def ngrams_1_2(toks: Column) -> Column:
    """Unigrams followed by bigrams of the filtered token sequence."""
    n = F.size(toks)
    bigrams = F.when(n >= 2, F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                                        lambda a, b: F.concat(a, F.lit(" "), b))
                     ).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


@functools.cache
def _count_udf():
    step = PART_TOKENS
    # Defined inside so it is shipped by value: executors need no copy of this package on their path.
    def part(toks: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa_
        import pyarrow.compute as pc
        n = len(toks)
        offs = np.zeros(n + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False), out=offs[1:])
        words = toks.flatten()
        doc = np.repeat(np.arange(n), np.diff(offs))
        left = np.flatnonzero(doc[1:] == doc[:-1])
        two = pc.binary_join_element_wise(words.take(pa_.array(left)), words.take(pa_.array(left + 1)), " ")
        terms = pa_.concat_arrays([words, two]).dictionary_encode()
        size = max(1, len(terms.dictionary))
        key = np.concatenate([doc, doc[left]]) * size + terms.indices.to_numpy(zero_copy_only=False)
        key, tf = np.unique(key, return_counts=True)
        rows = pa_.StructArray.from_arrays(
            [terms.dictionary.take(pa_.array(key % size)), pa_.array(tf.astype(np.int64))], ["term", "tf"])
        cuts = np.searchsorted(key // size, np.arange(n + 1)).astype(np.int32)
        sq = np.bincount(key // size, tf.astype(np.float64) ** 2, n).astype(np.int64)
        return pa_.StructArray.from_arrays([pa_.ListArray.from_arrays(pa_.array(cuts), rows), pa_.array(sq)], ["terms", "sq"])

    def counted(toks: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa_
        import pyarrow.compute as pc
        # The working arrays are ten times the tokens, so a batch is counted some documents at a time.
        ends = np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // step, prepend=0)).tolist()
        cuts = [0, *[c for c in cuts if c > 0], len(toks)]
        parts = [part(toks.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
        del toks
        pa_.default_memory_pool().release_unused()
        return parts[0] if len(parts) == 1 else pa_.concat_arrays(parts)

    return F.arrow_udf(counted, "struct<terms: array<struct<term: string, tf: bigint>>, sq: bigint>")


def counted_terms(text: Column | str) -> Column:
    """``struct<terms: array<struct<term, tf>>, sq>``: the text's 1-2-grams with their counts and
    ``Σ tf²``; no terms for a null text. Counted for ``PART_TOKENS`` of an Arrow batch at once; the batch itself is
    bounded by bytes (see :mod:`~hirelens.session`)."""
    return _count_udf()(tokens(text))


def term_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Long form ``(id, term, tf, sq)`` of a table with ``terms`` and ``sq``."""
    t = df.select(F.col(id_col).alias("id"), F.explode("terms").alias("t"), "sq")
    return t.select("id", "t.term", "t.tf", "sq")


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Long table ``(id, term, tf BIGINT, sq BIGINT)``: raw term counts per
    document and the document's ``Σ tf²`` carried on every term row.

    A document is counted where it is read; nothing is exchanged. Ids must be unique.
    (explode, ``groupBy(id, term)`` and a window by id took two exchanges of all terms and
    twice the time; counting with lambdas on arrays took longer still.)
    """
    c = df.select(F.col(id_col).alias(id_col), counted_terms(text_col).alias("c"))
    return term_rows(c.select(id_col, "c.terms", "c.sq"), id_col)


def cosine_expr(dot: Column, rr: Column, jj: Column, sr: Column, sj: Column) -> Column:
    """Closed-form cosine x 100 rounded like Python; 0.0 without shared terms."""
    c2 = F.lit(C2)
    one_minus = F.lit(1.0 - C2)
    nr = c2 * sr.cast("double") + one_minus * rr.cast("double")
    nj = c2 * sj.cast("double") + one_minus * jj.cast("double")
    cos = dot.cast("double") / F.sqrt(nr * nj)
    return F.when(F.coalesce(dot, F.lit(0)) == 0, F.lit(0.0)).otherwise(py_round2(cos * F.lit(100.0)))


def pair_similarity(pairs: DataFrame, resume_tf: DataFrame, job_tf: DataFrame, small_jobs: bool = False) -> DataFrame:
    """``(resume_id, job_id, similarity_score)`` for every distinct pair.

    ``pairs`` needs ``resume_id, job_id``; ``*_tf`` come from :func:`term_rows` or
    :func:`term_frequencies`. Pairs without a shared term get 0.0 (their
    norms are irrelevant, so the per-document norms only travel with the
    shared-term rows). ``small_jobs``: the caller has measured the jobs' terms
    and found them fit to broadcast.
    """
    p = pairs.select("resume_id", "job_id").distinct()
    hint = F.broadcast if small_jobs else lambda x: x
    jt = job_tf.select(F.col("id").alias("job_id"), "term", F.col("tf").alias("tf_j"),
                       F.col("sq").alias("sj"))
    rt = resume_tf.select(F.col("id").alias("resume_id"), "term", F.col("tf").alias("tf_r"),
                          F.col("sq").alias("sr"))
    # terms that no job has can't be shared; the documents' norms are on the rows already
    rt = rt.join(hint(jt.select("term").distinct()), "term", "left_semi")
    shared = (p.join(hint(jt), "job_id")
               .join(rt, ["resume_id", "term"])
               .groupBy("resume_id", "job_id")
               .agg(F.sum(F.col("tf_r") * F.col("tf_j")).alias("dot"),
                    F.sum(F.col("tf_r") * F.col("tf_r")).alias("rr"),
                    F.sum(F.col("tf_j") * F.col("tf_j")).alias("jj"),
                    F.max("sr").alias("sr"), F.max("sj").alias("sj")))
    out = p.join(shared, ["resume_id", "job_id"], "left")
    return out.select("resume_id", "job_id",
                      cosine_expr(F.col("dot"), F.col("rr"), F.col("jj"),
                                  F.col("sr"), F.col("sj")).alias("similarity_score"))
