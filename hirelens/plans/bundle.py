"""Full analysis bundle per application, latest bundle per session, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, py_round_int, strip
from ..operators.match import match_features, match_pairs
from ..operators.scorecard import scorecard
from ..session import is_small, keep
from ..sources.ingest import failure_message, file_gate, input_gate_flags, resume_record
from .sink import write_version


def safe_score(*values) -> F.Column:
    """First non-null score, rounded half-even and clamped to 0..100; else 0."""
    v = F.coalesce(*values)
    return F.coalesce(F.least(F.lit(100), F.greatest(F.lit(0), py_round_int(v))), F.lit(0)).cast("int")


def prepare(resumes: DataFrame) -> DataFrame:
    """Gates and clean-up of the uploaded documents: type, empty file, then the
    cleaned text, its statistics and the no-text error. One row per document;
    an error leaves the row without text.

    ``resumes(resume_id, filename, extension, text[, length])``."""
    size = F.col("length") if "length" in resumes.columns else F.lit(1)
    gated = resumes.select("resume_id", "filename", "extension", "text", file_gate(F.col("extension"), size).alias("error"))
    cleaned = gated.withColumn("text", F.when(F.col("error").isNull(), clean_text("text")))
    return resume_record(cleaned)


def resume_features(resumes: DataFrame) -> DataFrame:
    """Everything the analyses need of an uploaded document, in one row without its text: gates
    (``error``), statistics, the scorecard, skills, terms and norm. One scan, no exchange, so it
    can be stored once per document (see :func:`store_features`) and read by every analysis.
    What failed a gate is not analysed.

    ``resumes(resume_id, filename, extension, text[, length])``."""
    rec = prepare(resumes)
    rec = rec.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    card = scorecard(rec.select("resume_id", "filename", "extension", "text", "characters", "words", "error"),
                     words=F.when(F.col("text").isNull(), 0).otherwise(F.col("words")).cast("int"))
    x = match_features(card)
    return x.select(
        "resume_id", "error", F.struct("filename", "extension", "characters", "words").alias("resume_data"),
        F.struct("score", "rating", "checks", "sections", "missing_sections", "word_count", "filename").alias("ats_result"),
        "technical_skills", "soft_skills", "terms", "sq")


def job_features(jobs: DataFrame) -> DataFrame:
    """The same of a job description: whether it is blank, skills, terms and norm. ``jobs(job_id, text)``."""
    j = jobs.select("job_id", "text", (F.coalesce(strip("text"), F.lit("")) == "").alias("job_blank"))
    return match_features(j)


def store_features(features: DataFrame, id_col: str, table: str, path: str, buckets: int) -> DataFrame:
    """Write a feature table bucketed by its id and read it back: joins and aggregations by the
    id then read it without an exchange. It replaces the table of that name and place."""
    spark = features.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (features.repartition(buckets, id_col).write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col)
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def with_errors(applications: DataFrame, resume_flags: DataFrame, job_flags: DataFrame, small_jobs: bool = False) -> DataFrame:
    """The applications with ``error``: why an application cannot be analysed.

    Gates need one flag per document, ``(resume_id, error)`` and ``(job_id, job_blank)``, not the texts:
    joining texts onto every application would copy a popular document into each of its rows."""
    r = resume_flags.select("resume_id", F.lit(True).alias("has_resume"), F.col("error").alias("extract_error"))
    j = job_flags.select("job_id", "job_blank")
    a = applications.join(r, "resume_id", "left").join(F.broadcast(j) if small_jobs else j, "job_id", "left")
    error = F.coalesce(input_gate_flags(F.coalesce(F.col("has_resume"), F.lit(False)),
                                        F.coalesce(F.col("job_blank"), F.lit(True))),
                       failure_message(F.col("extract_error")))
    return a.select(*applications.columns, error.alias("error"))


def applied(applications: DataFrame, records: DataFrame, jobs: DataFrame) -> DataFrame:
    """:func:`with_errors` from extraction records and job texts."""
    return with_errors(applications, records, jobs.select(
        "job_id", (F.coalesce(strip("text"), F.lit("")) == "").alias("job_blank")))


def analyze(applications: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Match result + scorecard + extraction record for every application.

    ``resumes(resume_id, filename, extension, text[, length])``;
    ``jobs(job_id, text)``. Documents pass the gates, are cleaned and analysed once each and
    their features kept; only similarity and set algebra are per pair. Applications whose inputs
    fail a gate keep their row with an ``error`` and no results.
    """
    return analyze_features(applications, keep(resume_features(resumes), "resume-features"), keep(job_features(jobs), "job-features"))


def analyze_features(applications: DataFrame, rf: DataFrame, jf: DataFrame) -> DataFrame:
    """:func:`analyze` from stored feature tables."""
    return results(with_errors(applications, rf, jf, is_small(jf)), rf, jf)


def results(a: DataFrame, rf: DataFrame, jf: DataFrame) -> DataFrame:
    """The results of gated applications from the documents' features."""
    m = match_pairs(a.where("error IS NULL"), rf, jf)
    match_result = F.struct(*[F.col(c) for c in m.columns if c not in ("resume_id", "job_id")])
    m = m.select("resume_id", "job_id", match_result.alias("match_result"))
    out = a.join(m, ["resume_id", "job_id"], "left").join(rf.select("resume_id", "resume_data", "ats_result"), "resume_id", "left")
    ok = F.col("error").isNull()
    cols = [c for c in a.columns if c != "error"]
    return out.select(
        *cols, F.when(ok, F.col("resume_data")).alias("resume_data"),
        F.when(ok, F.col("match_result")).alias("match_result"), F.when(ok, F.col("ats_result")).alias("ats_result"), "error",
        F.when(ok, safe_score(F.col("match_result.overall_score"))).alias("job_match_score"),
        F.when(ok, safe_score(F.col("match_result.technical_score"))).alias("technical_score"),
        F.when(ok, safe_score(F.col("match_result.similarity_score"))).alias("similarity_score"),
        F.when(ok, safe_score(F.col("ats_result.score"))).alias("ats_score"))


def latest_per_session(bundles: DataFrame, session_col: str = "session_id", ts_col: str = "ts",
                       tie_col: str = "application_id") -> DataFrame:
    """The last *successful* row per session: a failed analysis leaves the one before in place.

    ``max`` over a struct led by (ts, tie-breaker) is an ordinary partial
    aggregate: map-side combine keeps a hot session from landing whole on
    one reducer, unlike a window sort.
    """
    if "error" in bundles.columns:
        bundles = bundles.where("error IS NULL")
    others = [c for c in bundles.columns if c not in (session_col, ts_col, tie_col, "error")]
    best = F.max(F.struct(F.col(ts_col).alias(ts_col), F.col(tie_col).alias(tie_col),
                          *[F.col(c) for c in others])).alias("b")
    return bundles.groupBy(session_col).agg(best).select(session_col, "b.*")


def latest_bundles(applications: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """The session state: the last successful application of each session is chosen
    from narrow rows and gate flags, and only those are analysed."""
    return latest_of_features(applications, keep(resume_features(resumes), "resume-features"), keep(job_features(jobs), "job-features"))


def latest_of_features(applications: DataFrame, rf: DataFrame, jf: DataFrame) -> DataFrame:
    """:func:`latest_bundles` from stored feature tables."""
    keys = with_errors(applications, rf, jf, is_small(jf)).select("session_id", "ts", "application_id", "resume_id", "job_id", "error")
    last = latest_per_session(keys).withColumn("error", F.lit(None).cast("string"))
    return results(last, rf, jf)


def write_bundles(bundles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain Parquet files, nested results kept as structs (job and résumé by their keys; a new
    analysis starts without a model answer)."""
    bundles.write.mode(mode).parquet(path)


def store_bundles(bundles: DataFrame, path: str) -> int:
    """The same as a versioned table: a write that fails leaves the last bundles in place, and
    their readers are not disturbed. Read with ``read_version``."""
    return write_version(bundles, path)


def with_answers(state: DataFrame, answers: DataFrame) -> DataFrame:
    """The session state with the model's answer: ``answers(session_id, application_id, result)``. A new
    analysis clears the answer, so only an answer to the session's last application is shown."""
    a = answers.groupBy("session_id", "application_id").agg(F.max("result").alias("result"))
    return state.join(a, ["session_id", "application_id"], "left")


def to_json_rows(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """JSON export of nested results (scorecard, redaction counts)."""
    return df.select(*keys, *[F.to_json(F.col(c)).alias(c) for c in cols])
