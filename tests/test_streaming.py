"""Streaming: row-local operators on readStream, latest-per-session state."""

import os
import tempfile

from conftest import SF_SMALL
from pyspark.sql import functions as F

from hirelens.operators.scorecard import scorecard
from hirelens.sources import tables as T
from hirelens.streaming import stream as S


def test_scorecard_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="hl-stream-")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    r = T.resumes(spark, SF_SMALL).withColumn("filename", F.lit("cv.pdf"))
    r = r.select("resume_id", "filename", "extension", "text")
    r.filter("resume_id < 100").write.parquet(os.path.join(src, "a"))
    r.filter("resume_id >= 100").write.parquet(os.path.join(src, "b"))
    q = S.write_stream(S.scorecard_stream(S.read_resumes(spark, src + "/*", max_files=1)), out,
                       f"cards-{os.path.basename(d)}")
    q.awaitTermination(300)
    got = {x.resume_id: x.score for x in spark.read.parquet(out).collect()}
    exp = {x.resume_id: x.score for x in scorecard(r).collect()}
    assert got == exp


def test_latest_session_state(spark):
    d = tempfile.mkdtemp(prefix="hl-sessions-")
    src, table = os.path.join(d, "apps"), os.path.join(d, "latest")
    a = T.applications(spark, SF_SMALL).select(
        "application_id", "session_id", "resume_id", "job_id", "ts",
        F.lit(1).alias("job_match_score"), F.lit(2).alias("ats_score"),
        F.when(F.col("application_id") % 5 == 0, "failed").alias("error"))
    a.filter("application_id % 2 = 0").write.parquet(os.path.join(src, "p1"))
    a.filter("application_id % 2 = 1").write.parquet(os.path.join(src, "p2"))
    stream = (spark.readStream.schema(S.APPLICATION_SCHEMA).option("maxFilesPerTrigger", 1)
              .parquet(src + "/*"))
    S.track_sessions(stream, table, f"sessions-{os.path.basename(d)}").awaitTermination(300)
    got = {(x.session_id, x.application_id) for x in S.latest_sessions(spark, table).collect()}
    exp = (a.where("error IS NULL").groupBy("session_id").agg(F.max(F.struct("ts", "application_id")).alias("m"))
           .select("session_id", "m.application_id").collect())
    assert got == {(x[0], x[1]) for x in exp}


def test_session_table_does_not_grow_with_batches(spark):
    from hirelens.plans import sink
    d = tempfile.mkdtemp(prefix="hl-buckets-")
    schema = "session_id string, ts timestamp, application_id long, score int, error string"
    rows = [(f"s{k % 5}", f"2024-01-01 00:{b:02d}:00", 100 * b + k, b, "failed" if (b + k) % 4 == 0 else None)
            for b in range(8) for k in range(7)]
    every = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    for b in range(8):
        batch = every.where(f"score = {b}")
        merge = lambda n: sink.merge_buckets(S.latest_per_session(batch), d, n, "session_id", 3, S.latest_per_session)
        assert merge(b) and not merge(b)                    # a replay changes nothing
    now = S.latest_sessions(spark, d)
    assert len(now.inputFiles()) <= 3
    want = S.latest_per_session(every).select("session_id", "application_id", "score").collect()
    assert sorted(map(tuple, now.select("session_id", "application_id", "score").collect())) == sorted(map(tuple, want))
    assert sink.Commits(spark, d).vacuum(1) > 0 and S.latest_sessions(spark, d).count() == 5


def test_bundles_of_streamed_applications(spark):
    from hirelens.plans import bundle as B
    from hirelens.plans import queries as Q
    from hirelens.session import keep
    d = tempfile.mkdtemp(prefix="hl-apps-")
    apps, jobs, uploads = T.applications(spark, SF_SMALL), T.jobs(spark, SF_SMALL), Q._uploads(spark, SF_SMALL)
    rf, jf = keep(B.resume_features(uploads), "rf"), keep(B.job_features(jobs), "jf")
    for k in range(2):
        apps.where(f"application_id % 2 = {k}").write.parquet(os.path.join(d, f"in/p{k}"))
    stream = spark.readStream.schema(apps.schema).option("maxFilesPerTrigger", 1).parquet(d + "/in/*")
    S.bundle_stream(stream, rf, jf, d + "/out", f"bundles-{os.path.basename(d)}").awaitTermination(600)
    cols = ["application_id", "session_id", "error", "job_match_score", "ats_score", "similarity_score"]
    got = spark.read.parquet(d + "/out").select(*cols)
    want = B.analyze(apps, uploads, jobs).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_answers_meet_their_requests(spark):
    d = tempfile.mkdtemp(prefix="hl-answers-")
    name = os.path.basename(d)
    answer = T.view(spark, SF_SMALL, "v_llm_responses").where("application_id = 2").first().output_text
    privacy = "struct<total_redactions: int>"
    requests = [[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (3, "2024-01-01 00:02:00"), (4, "2024-01-01 00:03:00")],
                [(9, "2024-01-01 09:00:00")], [(10, "2024-01-01 12:00:00")]]
    answers = [[(1, "2024-01-01 00:05:00", answer, None), (2, "2024-01-01 00:06:00", None, "429 too many")],
               [(3, "2024-01-01 02:00:00", answer, None), (9, "2024-01-01 09:10:00", "[1]", None)],
               [(4, "2024-01-01 00:04:00", answer, None), (77, "2024-01-01 12:00:00", answer, None)]]
    rs = f"application_id long, sent_at timestamp, privacy {privacy}"
    as_ = "application_id long, answered_at timestamp, output_text string, error string"
    q = None
    for k in range(3):                                      # the last answer comes long after its watermark
        spark.createDataFrame([(i, t) for i, t in requests[k]], "application_id long, t string").select(
            "application_id", F.to_timestamp("t").alias("sent_at"), F.struct(F.lit(5).alias("total_redactions")).alias("privacy")
        ).coalesce(1).write.parquet(f"{d}/r/{k}")
        spark.createDataFrame(answers[k], "application_id long, t string, output_text string, error string").select(
            "application_id", F.to_timestamp("t").alias("answered_at"), "output_text", "error").coalesce(1).write.parquet(f"{d}/a/{k}")
        out = S.results_stream(spark.readStream.schema(rs).parquet(f"{d}/r/*"), spark.readStream.schema(as_).parquet(f"{d}/a/*"))
        q = S.write_stream(out, f"{d}/out", f"answers-{name}")
        q.awaitTermination(300)
    got = {r.application_id: r for r in spark.read.parquet(f"{d}/out").collect()}
    assert got[1].result.privacy.total_redactions == 5 and got[1].error_class is None and not got[1].missing
    assert got[2].error_class == "rate_limit" and got[2].result is None
    assert got[9].error_class == "other" and got[9].result is None
    assert got[3].missing and got[4].missing and got[3].result is None and got[3].error_class is None
    assert 77 not in got and 10 not in got                  # no request; still waiting
