"""Résumé-to-job match: skills, set algebra, percentages, similarity, overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import py_round2
from ..session import is_small, keep
from .similarity import counted_terms, pair_similarity, term_rows
from .skills import match_percentage, matched, missing, with_skills

MATCH_COLUMNS = [
    "overall_score", "technical_score", "soft_skill_score", "similarity_score",
    "job_technical_skills", "resume_technical_skills", "matched_technical", "missing_technical",
    "job_soft_skills", "resume_soft_skills", "matched_soft", "missing_soft",
]


def overall_score(tech: Column, soft: Column, sim: Column,
                  has_tech: Column, has_soft: Column) -> Column:
    """Weighted mean over the skill families the job names, plus similarity;
    accumulated left to right like the reference, then rounded."""
    w_t, w_s, w_sim = fixed.WEIGHT_TECHNICAL, fixed.WEIGHT_SOFT, fixed.WEIGHT_SIMILARITY
    acc = (F.when(has_tech, tech * F.lit(float(w_t))).otherwise(F.lit(0.0))
           + F.when(has_soft, soft * F.lit(float(w_s))).otherwise(F.lit(0.0))
           + sim * F.lit(float(w_sim)))
    weight = (F.when(has_tech, F.lit(w_t)).otherwise(F.lit(0))
              + F.when(has_soft, F.lit(w_s)).otherwise(F.lit(0)) + F.lit(w_sim))
    return py_round2(acc / weight.cast("double"))


def match_features(df: DataFrame, text_col: str = "text", technical=None, soft=None) -> DataFrame:
    """``technical_skills, soft_skills, terms, sq`` in place of the text: all that a match needs
    of a document, from one scan and without an exchange."""
    x = with_skills(df, text_col, "", technical, soft)
    return x.withColumn("__c", counted_terms(text_col)).withColumns(
        {"terms": F.col("__c.terms"), "sq": F.col("__c.sq")}).drop("__c", text_col)


def match_pairs(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per distinct ``(resume_id, job_id)`` with the twelve match fields, from stored
    :func:`match_features` tables: only ids, skills and terms are joined, never a text."""
    pairs = pairs.select("resume_id", "job_id").distinct()
    small = is_small(jobs, F.size("terms") + 1)
    sim = pair_similarity(pairs, term_rows(resumes, "resume_id"), term_rows(jobs, "job_id"), small)
    r_sk = resumes.select("resume_id", F.col("technical_skills").alias("resume_technical_skills"),
                          F.col("soft_skills").alias("resume_soft_skills"))
    j_sk = jobs.select("job_id", F.col("technical_skills").alias("job_technical_skills"),
                       F.col("soft_skills").alias("job_soft_skills"))
    p = sim.join(r_sk, "resume_id").join(F.broadcast(j_sk) if small else j_sk, "job_id")
    jt, rt = F.col("job_technical_skills"), F.col("resume_technical_skills")
    js, rs = F.col("job_soft_skills"), F.col("resume_soft_skills")
    p = p.select(
        "resume_id", "job_id", "similarity_score",
        jt.alias("job_technical_skills"), rt.alias("resume_technical_skills"),
        matched(jt, rt).alias("matched_technical"), missing(jt, rt).alias("missing_technical"),
        js.alias("job_soft_skills"), rs.alias("resume_soft_skills"),
        matched(js, rs).alias("matched_soft"), missing(js, rs).alias("missing_soft"),
        match_percentage(jt, rt).alias("technical_score"),
        match_percentage(js, rs).alias("soft_skill_score"),
    )
    return p.withColumn("overall_score", overall_score(
        F.col("technical_score"), F.col("soft_skill_score"), F.col("similarity_score"),
        F.size(jt) > 0, F.size(js) > 0)).select("resume_id", "job_id", *MATCH_COLUMNS)


def analyze_match(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame, *,
                  resume_text: str = "text", job_text: str = "text",
                  technical=None, soft=None) -> DataFrame:
    """:func:`match_pairs` from texts: ``resumes(resume_id, text)``, ``jobs(job_id, text)``.
    The documents' features are stored first, so each text is read once."""
    r = keep(match_features(resumes.select("resume_id", resume_text), resume_text, technical, soft), "resume-features")
    j = keep(match_features(jobs.select("job_id", job_text), job_text, technical, soft), "job-features")
    return match_pairs(pairs, r, j)
