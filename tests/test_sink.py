"""Versioned sink, cleared answers, file inventory, top-k jobs."""

import os
import random

import pytest
import tfidf
from pyspark.sql import functions as F

from hirelens.operators.match import match_features
from hirelens.operators.topk import best_jobs
from hirelens.plans import bundle as B
from hirelens.plans import sink
from hirelens.sources import ingest


def test_versions_and_failed_writes(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sink.read_version(spark, path) is None
    one = spark.range(3).withColumn("s", F.struct(F.col("id").alias("x")))
    assert sink.write_version(one, path) == 0
    old = sink.read_version(spark, path)
    broken = spark.range(3).select("id", F.struct(F.raise_error(F.lit("lost")).cast("long").alias("x")).alias("s"))
    with pytest.raises(Exception, match="lost"):
        sink.write_version(broken, path)
    assert sorted(r.id for r in sink.read_version(spark, path).collect()) == [0, 1, 2]
    assert sink.write_version(spark.range(5).withColumn("s", F.struct(F.col("id").alias("x"))), path) == 1
    assert sink.read_version(spark, path).count() == 5 and old.count() == 3 and sink.read_version(spark, path, 0).count() == 3
    commits = sink.Commits(spark, path)
    assert not commits.add(1, {"folders": {}}) and commits.numbers() == [0, 1]
    assert commits.vacuum(1) == 2 and sink.read_version(spark, path).count() == 5       # the old version and the failed one
    assert sink.write_version(one.where("false"), path) == 2 and sink.read_version(spark, path).count() == 0


def test_a_new_analysis_clears_the_answer(spark):
    state = spark.createDataFrame([("s", 2), ("t", 5), (None, 7)], "session_id string, application_id long")
    answers = spark.createDataFrame([("s", 1, "old"), ("t", 5, "now"), ("t", 5, "now")], "session_id string, application_id long, result string")
    assert {r.session_id: r.result for r in B.with_answers(state, answers).collect()} == {"s": None, "t": "now", None: None}


def test_files_are_listed_by_prefix(spark, tmp_path):
    sizes = {}
    for k in range(3):
        os.makedirs(tmp_path / f"p{k}/deep/er")
        for i, place in enumerate(["a.PDF", "deep/b.docx", "deep/er/ü c.txt", "empty.pdf"]):
            (tmp_path / f"p{k}" / place).write_bytes(b"x" * (0 if place == "empty.pdf" else 10 * k + i))
            sizes[str(tmp_path / f"p{k}" / place)] = 0 if place == "empty.pdf" else 10 * k + i
    own = spark.createDataFrame([(str(tmp_path / f"p{k}"),) for k in range(3)] + [(f"file://{tmp_path}/p1/deep",), (str(tmp_path / "none"),), (None,)],
                                "prefix string")
    listed = ingest.list_files(own)
    assert {r.path.removeprefix("file://"): r.length for r in listed.collect()} == sizes and listed.count() == 12
    files = ingest.read_files(spark, str(tmp_path), inventory=listed)
    assert sorted(len(r.content) for r in files.collect()) == sorted(sizes.values())
    assert ingest.list_files(own.where("false")).count() == 0


@pytest.mark.parametrize("champions", [1, 3, 16])
def test_best_jobs_against_all_pairs(spark, champions):
    rng = random.Random(champions)
    common, rare = ["data", "team", "work"], ["skill%d" % i for i in range(60)]

    def text(n):
        return " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))

    resumes = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, "skill1 skill2"), (101, "nothing shared here"), (102, "")]
    jobs = [(i, text(rng.randint(0, 25))) for i in range(40)] + [(50, "skill1 skill2"), (51, "skill1 skill2"), (52, None), (53, "unrelated")]
    rf, jf = (match_features(spark.createDataFrame(x, f"{n} long, text string")) for x, n in ((resumes, "resume_id"), (jobs, "job_id")))
    got = {}
    for r in best_jobs(rf, jf, 4, champions).collect():
        got.setdefault(r.resume_id, []).append((r.rank, r.job_id, r.similarity_score))
    for i, t in resumes:
        every = sorted((-tfidf.similarity(t, j or ""), k) for k, j in jobs)
        want = [(n + 1, k, -s) for n, (s, k) in enumerate(x for x in every if x[0] < 0) if n < 4]
        assert sorted(got.get(i, [])) == want, i


def test_kept_tables_are_removed(spark):
    from hirelens import session
    session.drop_kept(spark)
    t = session.keep(spark.range(5), "test")
    assert t.count() == 5 and session.drop_kept(spark) == 1 and session.drop_kept(spark) == 0
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST|No such file"):
        t.count()
