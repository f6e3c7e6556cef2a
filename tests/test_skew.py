"""A hot key (one job in a third of all applications, one résumé in a third of
them) through the similarity plan with broadcasts off and AQE's skew split
forced, checked pair by pair against the direct computation."""

import tfidf
from conftest import SF_SMALL
from pyspark.sql import functions as F

from hirelens.operators.similarity import pair_similarity, term_frequencies
from hirelens.sources import tables as T


def test_hot_job_and_resume(spark):
    conf = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        r, j = T.resumes(spark, SF_SMALL), T.jobs(spark, SF_SMALL)
        a = T.applications(spark, SF_SMALL)
        hot = (a.withColumn("job_id", F.when(F.col("application_id") % 3 == 0, F.lit(0))
                                        .otherwise(F.col("job_id")))
                .withColumn("resume_id", F.when(F.col("application_id") % 3 == 1, F.lit(7))
                                          .otherwise(F.col("resume_id"))))
        sim = pair_similarity(hot, term_frequencies(r, "resume_id", "text"),
                              term_frequencies(j, "job_id", "text"))
        got = {(x.resume_id, x.job_id): x.similarity_score for x in sim.collect()}
        pairs = {(x.resume_id, x.job_id) for x in hot.select("resume_id", "job_id").collect()}
        assert set(got) == pairs
        rt = {x.resume_id: x.text for x in r.collect()}
        jt = {x.job_id: x.text for x in j.collect()}
        for (ri, ji), v in got.items():
            assert abs(v - tfidf.similarity(rt.get(ri, ""), jt[ji])) <= 0.01
        assert "Broadcast" not in sim._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_best_jobs_direct_equals_bounded_search(spark):
    """Every pair scored by lists, against the search by bounds and the pairs one by one; without
    any exchange but the one by resume_id."""
    from hirelens.operators import topk
    from hirelens.operators.similarity import counted_terms
    from hirelens.session import keep

    words = ["sql", "spark", "join", "scan", "plan", "query", "table", "disk"]
    docs = [(i, " ".join(words[(i * k + k) % 8] for k in range(i % 9))) for i in range(60)] + [(None, "sql spark"), (7, "disk scan")]
    jobs = [(i, " ".join(words[(i + 3 * k) % 8] for k in range(1 + i % 5))) for i in range(12)] + [(None, "sql"), (20, None)]

    def terms(rows, name):
        df = spark.createDataFrame(rows, f"{name} long, text string")
        return keep(df.select(name, counted_terms("text").alias("c")).select(name, "c.terms", "c.sq"), "t")

    r, j = terms(docs, "resume_id"), terms(jobs, "job_id")
    direct = topk.direct_best_jobs(r, j, 3)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, topk.best_jobs(r, j, 3, champions=2).collect()))
    plan = direct._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_term_counts_in_parts_equal_one_part(spark, monkeypatch):
    """A batch counted a few documents at a time gives the same terms; batches are bounded by bytes."""
    from hirelens.operators import similarity as S

    docs = spark.createDataFrame([(i, None if i % 7 == 3 else "alpha beta " * (i % 5) + f"w{i} gamma") for i in range(50)],
                                 "id long, text string")
    whole = sorted(map(tuple, term_frequencies(docs, "id", "text").collect()))
    S._count_udf.cache_clear()
    monkeypatch.setattr(S, "PART_TOKENS", 5)
    try:
        assert sorted(map(tuple, term_frequencies(docs, "id", "text").collect())) == whole
    finally:
        S._count_udf.cache_clear()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8MB"
