"""Skills, similarity and the overall match; the oracle SQL judges every pair of the fixture (test_entry)."""

import re
import unicodedata
import tfidf
from conftest import SF_SMALL, one_col
from pyspark.sql import functions as F

from hirelens.functions import fixed
from hirelens.operators.match import analyze_match
from hirelens.operators.similarity import pair_similarity, term_frequencies
from hirelens.operators.skills import find_skills
from hirelens.functions.text import normalize_text
from hirelens.sources import tables as T


def test_skill_goldens(spark):
    texts = ["C++ and C#", "I know c well", "javascript only", "spring boot apps",
             "ＰＹＴＨＯＮ developer", "see github.com/x", "objective-c", "c-level", "node.js and vue.js",
             "machine learning / ML", "", "Cpp, c sharp, k8s", "c language", "react.js"]
    got = one_col(spark, texts, lambda c: find_skills(normalize_text(c), fixed.TECHNICAL_SKILLS))
    assert got[:6] == [["C#", "C++"], ["C"], ["JavaScript"], ["Spring", "Spring Boot"], ["Python"], ["Git"]]
    assert got[10] == [] and {"C++", "C#", "Kubernetes"} <= set(got[11]) and "Java" not in got[13]
    soft = one_col(spark, ["Team player, problem-solving", "multi-task"],
                   lambda c: find_skills(normalize_text(c), fixed.SOFT_SKILLS))
    assert soft == [["Problem Solving", "Teamwork"], ["Multitasking"]]


def _sim(spark, pairs):
    r = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "resume_id long, text string")
    j = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "job_id long, text string")
    p = spark.createDataFrame([(i, i) for i in range(len(pairs))], "resume_id long, job_id long")
    s = pair_similarity(p, term_frequencies(r, "resume_id", "text"), term_frequencies(j, "job_id", "text"))
    return [x["similarity_score"] for x in s.orderBy("resume_id").collect()]


def test_similarity_goldens(spark):
    pairs = [("python data engineer", "python data engineer"), ("alpha beta", "gamma delta"),
             ("the and of", "the and of"), ("", "python"), ("", ""),
             ("data data pipelines spark", "spark data"), ("Ünïcode wörds here", "wörds here too")]
    got = _sim(spark, pairs)
    assert got == [tfidf.similarity(a, b) for a, b in pairs]
    assert got[0] == 100.0 and got[1] == 0.0 and got[2] == 0.0 and got[3] == 0.0


def test_overall_score(spark):
    r = spark.createDataFrame([(1, "Python and SQL, teamwork"), (2, "nothing here")], "resume_id long, text string")
    j = spark.createDataFrame([(1, "Python, SQL, Docker and AWS; teamwork"), (2, "plain words")], "job_id long, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (1, 1)], "resume_id long, job_id long")
    got = {(x.resume_id, x.job_id): x for x in analyze_match(pairs, r, j).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    texts = {(x, y): tfidf.similarity(a, b) for x, a in ((1, "Python and SQL, teamwork"), (2, "nothing here"))
             for y, b in ((1, "Python, SQL, Docker and AWS; teamwork"), (2, "plain words"))}
    top = got[1, 1]
    assert (top.technical_score, top.soft_skill_score, top.similarity_score) == (50.0, 100.0, texts[1, 1])
    assert top.overall_score == round((50 * 55 + 100 * 15 + texts[1, 1] * 30) / 100, 2)
    assert top.missing_technical == ["AWS", "Docker"] and top.matched_technical == ["Python", "SQL"]
    assert got[1, 2].overall_score == texts[1, 2]        # the job names no skill: similarity alone counts
    assert got[2, 1].overall_score == round(texts[2, 1] * 30 / 100, 2)


def test_invariants(spark):
    m = analyze_match(T.applications(spark, SF_SMALL), T.resumes(spark, SF_SMALL), T.jobs(spark, SF_SMALL))
    bad = m.filter(
        (F.col("overall_score") < 0) | (F.col("overall_score") > 100)
        | (F.size(F.array_intersect("matched_technical", "missing_technical")) > 0)
        | (F.size(F.array_union("matched_technical", "missing_technical"))
           != F.size("job_technical_skills")))
    assert bad.count() == 0


def test_a_text_is_folded_once_and_aliases_are_found_alone(spark):
    """The plan folds a text once for all skills; the short prefilter loses no alias."""
    from hirelens.functions import fixed
    from hirelens.operators.skills import _shortest, with_skills
    aliases = {**fixed.TECHNICAL_SKILLS, **fixed.SOFT_SKILLS}
    texts = [f"{x}{a}{y}" for own in aliases.values() for a in own for x, y in (("", ""), ("é", ""), (". ", ",ß"), ("+", ""), ("", "_"))]
    df = with_skills(spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string"), "text")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 4

    def found(text, catalog):
        edge = r"[^\W]|[+#]"
        return sorted(n for n, own in catalog.items() if any(
            re.search(rf"(?<!{edge}){re.escape(a.casefold())}(?!{edge})".replace(edge, r"[\w+#]"), text) for a in own))

    for r in df.collect():
        text = unicodedata.normalize("NFKC", r.text or "").casefold()
        assert r.technical_skills == found(text, fixed.TECHNICAL_SKILLS), r.text
        assert r.soft_skills == found(text, fixed.SOFT_SKILLS), r.text
    assert _shortest(["c language", "programming in c", "c"]) == ["c"]
