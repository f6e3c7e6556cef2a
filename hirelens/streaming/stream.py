"""The same operators on Structured Streaming.

Extraction stats, the scorecard and redaction are row-local projections,
so they run unchanged on a ``readStream`` source. The only state the
reference keeps -- the latest successful analysis per session -- is a
bucketed table into which each micro-batch is merged (``max`` over
(ts, application_id), partial, so a hot session never gathers on one task).
Applications that stream in are analysed against stored feature tables, and
answers of the model meet their requests in a stream-stream join.
Checkpoints live under the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recommend import call_error, error_class, error_message, parse_responses, result_wrapper
from ..operators.redact import redact
from ..operators.scorecard import scorecard
from ..plans.bundle import analyze_features, latest_per_session
from ..plans.sink import merge_buckets, read_version
from ..session import checkpoint_dir

RESUME_SCHEMA = "resume_id long, filename string, extension string, text string"
APPLICATION_SCHEMA = ("application_id long, session_id string, resume_id long, job_id long, "
                      "ts timestamp, job_match_score int, ats_score int, error string")


def read_resumes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(RESUME_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def scorecard_stream(resumes: DataFrame) -> DataFrame:
    """Per-résumé score, rating and redaction counts as a stream."""
    card = scorecard(resumes.select("resume_id", "filename", "extension", "text"))
    red = redact(card, "text")
    return red.select("resume_id", "filename", "score", "rating", "missing_sections",
                      "word_count", "redactions", "total_redactions", "candidate_name_detected")


def write_stream(df: DataFrame, out_path: str, name: str, available_now: bool = True):
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    w = (df.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


BUCKETS = 64


def latest_sessions(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The state as it stands: one row per session, from the current files of the buckets."""
    return read_version(spark, table_path)


def track_sessions(applications: DataFrame, table_path: str, name: str = "sessions", buckets: int = BUCKETS):
    """Keep the last successful application per session (rows with an ``error`` don't count) in a
    table of fixed buckets: a micro-batch is reduced to its own last rows, then merged into the
    buckets it touches. The table is the only state, so nothing grows in a state store."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(latest_per_session(batch), table_path, batch_id, "session_id", buckets, latest_per_session)

    return _for_each_batch(applications, handle, name)


def _for_each_batch(stream: DataFrame, handle, name: str):
    ckpt = os.path.join(checkpoint_dir(stream.sparkSession), "streams", name)
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt).trigger(availableNow=True).start())


def bundle_stream(applications: DataFrame, resume_features: DataFrame, job_features: DataFrame, out_path: str, name: str = "bundles"):
    """Applications arrive as a stream, the documents' features are stored tables: every micro-batch
    is analysed like a batch and written to a folder of its own (a replay writes it again)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        analyze_features(batch, resume_features, job_features).write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    return _for_each_batch(applications, handle, name)


def results_stream(requests: DataFrame, answers: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Answers joined to the requests they belong to, as both arrive.

    ``requests(application_id, sent_at, privacy)``, ``answers(application_id, answered_at, output_text, error)``.
    An answer counts if it comes within ``wait`` after its request; a request without one is given out
    as missing once no such answer can come. Rows later than ``late`` behind the stream are dropped.
    Both watermarks bound the state: a row is held for ``wait`` + ``late`` at most."""
    r = requests.select(F.col("application_id"), "sent_at", "privacy").withWatermark("sent_at", late)
    a = answers.select(F.col("application_id").alias("__id"), "answered_at", "output_text", "error").withWatermark("answered_at", late)
    met = r.join(a, (F.col("application_id") == F.col("__id")) & (F.col("answered_at") >= F.col("sent_at"))
                 & (F.col("answered_at") <= F.col("sent_at") + F.expr(f"INTERVAL {wait}")), "left_outer")
    parsed = parse_responses(met)
    missing = F.col("__id").isNull()
    err = F.when(~missing, call_error("error", "validation_error"))
    ok = ~missing & err.isNull()
    return parsed.select(
        "application_id", "sent_at", "answered_at", missing.alias("missing"),
        F.when(ok, result_wrapper(F.col("analysis"), F.col("privacy"))).alias("result"),
        error_class(err).alias("error_class"), error_message(err).alias("message"))
