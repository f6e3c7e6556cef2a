"""The k most similar jobs of every résumé, without scoring all pairs.

The similarity is that of :mod:`~hirelens.operators.similarity`. Let x be the share
of the résumé's ``Σ tf²`` in terms that the pair shares, y the job's. By Cauchy-Schwarz

    sim <= f(x) · f(y) <= f(x),   f(x) = sqrt(x / (c² - (c² - 1) x)),

and f grows with x. So a score to beat bounds what must be looked at:

1. Champions. Each term keeps the jobs in which it weighs most (tf² over the job's
   ``Σ tf²``), ``CHAMPIONS`` at most. A résumé's terms met with these short lists
   give it a few jobs; the exact scores of the best ``2k`` of them give the score its
   k-th best job has at least.
2. Prefix. The résumé's terms are put in order of how many jobs have them, the most
   common first. As long as f of their summed share stays below that score they are
   left out: a job that shares only such terms cannot be among the k best.
3. Inverted lists. The other terms are joined with the jobs by term. A met job is
   dropped if f of the shared share, the left-out terms counted in full, is below the score.
4. The jobs left are scored exactly, the k best stay.

With few jobs (``DIRECT_JOBS``, their terms fit to broadcast) bounds save nothing: step 3 for all
terms *is* the exact score. Then the terms shared with any job are numbered where a résumé is read and
exchanged once, as narrow rows by ``resume_id``; lists, scores and ranks need no further exchange, and
nothing is stored.

Nothing is cut off that could be a result: without k champions the score to beat is
0 and all terms are looked up. Common terms, whose lists are long, are the first to be left
out; a list that is still hot is split by AQE's skew join.

Defined results: only pairs with a score above 0 count; ties go to the smaller job_id; ids
must be unique and not null; documents without terms have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small, keep
from .similarity import C2, cosine_expr, pair_similarity, term_rows

CHAMPIONS = 16
DIRECT_JOBS = 2000


def _bound(x: Column) -> Column:
    """100 f(x)."""
    x = F.least(x, F.lit(1.0))
    return F.lit(100.0) * F.sqrt(x / (F.lit(C2) - F.lit(C2 - 1.0) * x))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("resume_id").orderBy(F.col("similarity_score").desc(), "job_id")
    return scores.where("similarity_score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def direct_best_jobs(resumes: DataFrame, jobs: DataFrame, k: int = 5) -> DataFrame:
    """:func:`best_jobs` by scoring every pair that shares a term; the jobs' terms are broadcast.
    ``resumes`` is read once, so it need not be stored."""
    jt = term_rows(jobs.where("job_id IS NOT NULL"), "job_id")
    lists = keep(jt.groupBy("term").agg(F.collect_list(F.struct(F.col("id").alias("job_id"), F.col("tf").alias("tf_j"),
                                                               F.col("sq").alias("sj"))).alias("list"))
                 .withColumn("no", F.monotonically_increasing_id()), "job-lists")
    rt = term_rows(resumes.where("resume_id IS NOT NULL"), "resume_id")
    shared = rt.join(F.broadcast(lists.select("term", "no")), "term").select(
        F.col("id").alias("resume_id"), "no", "tf", "sq").repartition("resume_id")
    met = shared.join(F.broadcast(lists.select("no", "list")), "no").select(
        "resume_id", F.col("tf").alias("tf_r"), F.col("sq").alias("sr"), F.explode("list").alias("j")).select(
        "resume_id", "tf_r", "sr", "j.*")
    sums = met.groupBy("resume_id", "job_id").agg(
        F.sum(F.col("tf_r") * F.col("tf_j")).alias("dot"), F.sum(F.col("tf_r") * F.col("tf_r")).alias("rr"),
        F.sum(F.col("tf_j") * F.col("tf_j")).alias("jj"), F.max("sr").alias("sr"), F.max("sj").alias("sj"))
    scores = sums.select("resume_id", "job_id", cosine_expr(*map(F.col, ("dot", "rr", "jj", "sr", "sj"))).alias("similarity_score"))
    return _best(scores, k).select("resume_id", "job_id", "similarity_score", "rank")


def best_jobs(resumes: DataFrame, jobs: DataFrame, k: int = 5, champions: int = CHAMPIONS) -> DataFrame:
    """``(resume_id, job_id, similarity_score, rank)`` from stored tables ``resumes(resume_id, terms, sq)``
    and ``jobs(job_id, terms, sq)`` (:func:`~hirelens.operators.match.match_features`)."""
    small = is_small(jobs, F.size("terms") + 1)
    rt, jt = term_rows(resumes, "resume_id"), term_rows(jobs, "job_id")
    weigh = Window.partitionBy("term").orderBy((F.col("tf") * F.col("tf") / F.col("sq")).desc(), "id")
    lists = keep(jt.withColumn("place", F.row_number().over(weigh)).withColumn(
        "jobs", F.count("*").over(Window.partitionBy("term"))), "job-lists")
    per_term = lists.where("place = 1").select("term", "jobs")
    hint = F.broadcast if small else lambda x: x

    # the résumés' terms that some job has, with the number of jobs
    shared = keep(rt.join(hint(per_term), "term").select(
        F.col("id").alias("resume_id"), "term", "tf", "sq", "jobs"), "shared-terms")

    top = lists.where(F.col("place") <= champions).select(
        "term", F.col("id").alias("job_id"), (F.col("tf") / F.sqrt("sq")).alias("w"))
    guess = shared.select("resume_id", "term", "tf").join(hint(top), "term").groupBy("resume_id", "job_id").agg(
        F.sum(F.col("tf") * F.col("w")).alias("w"))
    first = Window.partitionBy("resume_id").orderBy(F.col("w").desc(), "job_id")
    guess = guess.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 2 * k).select("resume_id", "job_id")
    known = keep(_best(pair_similarity(guess, rt, jt, small), k), "champions")
    # one hundredth less: scores are rounded
    beat = known.where(F.col("rank") == k).select("resume_id", (F.col("similarity_score") - 0.01).alias("beat"))

    common = Window.partitionBy("resume_id").orderBy(F.col("jobs").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    prefix = shared.join(beat, "resume_id", "left").withColumn("mass", F.sum(F.col("tf") * F.col("tf")).over(common))
    out = F.coalesce(_bound(F.col("mass") / F.col("sq")) < F.col("beat"), F.lit(False))
    prefix = prefix.withColumn("out", out).withColumn(
        "rest", F.max(F.when(F.col("out"), F.col("mass")).otherwise(0)).over(Window.partitionBy("resume_id")))
    met = prefix.where("NOT out").join(hint(lists.select("term", F.col("id").alias("job_id"))), "term")
    met = met.groupBy("resume_id", "job_id").agg(
        (F.sum(F.col("tf") * F.col("tf")) + F.max("rest")).alias("mass"), F.max("sq").alias("sq"), F.max("beat").alias("beat"))
    left = met.where(F.coalesce(_bound(F.col("mass") / F.col("sq")) >= F.col("beat"), F.lit(True))).select("resume_id", "job_id")
    left = left.unionByName(known.select("resume_id", "job_id"))        # pair_similarity takes distinct pairs
    return _best(pair_similarity(left, rt, jt, small), k).select("resume_id", "job_id", "similarity_score", "rank")
