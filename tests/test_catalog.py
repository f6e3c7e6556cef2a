"""Skill detection by a catalog table: the rule of ``find_skills``, with any number of aliases."""

import random
import re
import unicodedata

from hirelens.functions import fixed
from hirelens.operators.catalog import alias_index, catalog_table, find_catalog_skills
from hirelens.operators.skills import with_skills
from hirelens.plans import bundle as B
from hirelens.session import is_small

EDGE = r"[\w+#]"


def norm(s):
    return unicodedata.normalize("NFKC", s).casefold()


def brute(text, catalog):
    t = norm(text or "")
    return sorted({s for s, own in catalog.items() for a in own
                   if a and re.search(f"(?<!{EDGE}){re.escape(norm(a))}(?!{EDGE})", t)})


TEXTS = [None, "", " ", "C++", "c++,C#;.net", "asp.net and .NET core", "x.net", "++", "a ++ b", "a++b", "+++", "( ++ )", "c++11", "C ++",
         "Python3 python", "xpython", "python-based", "python+", "#python", "ＰＹＴＨＯＮ", "node.js/react.js", "node  js", "ci/cd ci-cd",
         "Straße strasse", "machine learning", "machine  learning", "machine\nlearning", "日本語 日本", "naïve café", "e-mail: a@b", "&& || &&&",
         "_python", "python_", "٣ ३", "c", "c#c", "C#.", "the end ++", "++ start", "rest api rest"]


def test_catalog_table_against_regex(spark):
    catalog = {"C++": ["c++", "C ++"], "C#": ["c#"], "C": ["c"], ".NET": [".net", "asp.net"], "Plus": ["++"], "And": ["&&", "||"],
               "Python": ["python", "PYTHON3"], "Node": ["node.js"], "CI": ["ci/cd", "ci-cd"], "Strasse": ["straße"],
               "ML": ["machine learning", "machine  learning"], "JP": ["日本"], "Cafe": ["naïve café"], "At": ["@b"], "End": ["end ++"],
               "Digits": ["٣"], "REST": ["rest api", "rest"], "Nothing": ["", None]}
    rng = random.Random(2)
    bits = ["c", "++", "#", ".", "net", " ", "python", "&&", "a", "_", "日本", "end", "/", "rest", "api"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = catalog_table(spark, "t", catalog)
    index = alias_index(rows.unionByName(rows))
    got = {r.doc_id: r.t_skills for r in find_catalog_skills(docs, "doc_id", "text", index, ["t"]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t, {k: [a for a in v if a] for k, v in catalog.items()}), t


def test_twenty_thousand_aliases_and_the_fixed_catalogs(spark):
    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(3000)]
    planted = {"skill %d" % k: [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4]))), "w%d+%d" % (k, k)] for k in range(10000)}
    texts = [" ".join(rng.choice(vocab) for _ in range(60)) + " " + rng.choice(planted["skill %d" % rng.randrange(10000)]) for _ in range(40)]
    texts += ["Python, SQL, Docker; teamwork", "C++ and C#, Linux, problem-solving", "node.js, react.js"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = catalog_table(spark, "big", planted).unionByName(catalog_table(spark, "technical", fixed.TECHNICAL_SKILLS)).unionByName(
        catalog_table(spark, "soft", fixed.SOFT_SKILLS))
    index = alias_index(rows)
    assert index.count() > 20000 and is_small(index)
    got = {r.doc_id: r for r in find_catalog_skills(docs, "doc_id", "text", index, ["big", "technical", "soft"]).collect()}
    known = {r.doc_id: r for r in with_skills(docs, "text").collect()}
    where = {}
    for s, own in planted.items():
        for a in own:
            where.setdefault(a, set()).add(s)
    longest = max(len(a.split()) for a in where)
    for i, t in enumerate(texts):
        w = t.split()
        phrases = {" ".join(w[a: a + k]) for k in range(1, longest + 1) for a in range(len(w) - k + 1)}
        assert got[i].big_skills == sorted(set().union(*[where.get(p, set()) for p in phrases]))
        assert got[i].technical_skills == known[i].technical_skills and got[i].soft_skills == known[i].soft_skills
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:                                                    # the same by exchange
        import hirelens.operators.catalog as C
        small, C.is_small = C.is_small, lambda *a: False
        again = {r.doc_id: r.big_skills for r in find_catalog_skills(docs, "doc_id", "text", index, ["big"]).collect()}
    finally:
        C.is_small = small
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
    assert again == {i: r.big_skills for i, r in got.items()}


def test_feature_table_bucketed_by_id(spark, tmp_path):
    rows = [(i, "cv%d.pdf" % i, ".pdf", "Python and SQL " * (i % 5) if i % 7 else "") for i in range(60)]
    resumes = spark.createDataFrame(rows, "resume_id long, filename string, extension string, text string")
    f = B.store_features(B.resume_features(resumes), "resume_id", "features_test", str(tmp_path / "features"), 4)
    plan = f.groupBy("resume_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and f.count() == 60
    assert f.where("error IS NOT NULL AND size(terms) > 0").count() == 0
    jobs = spark.createDataFrame([(1, "Python"), (2, " ")], "job_id long, text string")
    apps = spark.createDataFrame([(i, "s", i, 1 + i % 2) for i in range(62)], "application_id long, session_id string, resume_id long, job_id long")
    one = B.analyze_features(apps, f, B.job_features(jobs)).select("application_id", "job_match_score", "ats_score", "error")
    two = B.analyze(apps, resumes, jobs).select("application_id", "job_match_score", "ats_score", "error")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    spark.sql("DROP TABLE features_test")


def test_only_words_that_begin_a_key_are_followed_up(spark):
    """Keys of several lengths with one first word, keys that end within a word, aliases at the text's ends;
    one row per word goes into the lookup, not one per phrase length."""
    from hirelens.operators.catalog import alias_index, find_catalog_skills
    rows = [("f", "one", "data"), ("f", "three", "data lake house"), ("f", "plus", "data++"), ("f", "dot", ".net"), ("f", "sign", "§")]
    texts = ["data lake houses", "Data  lake house", "a data lake house", "data", "data++", "data+ x", "x.net", "x .net", "§ a", "a§", "", None]
    index = alias_index(spark.createDataFrame(rows, "family string, skill string, alias string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = find_catalog_skills(docs, "id", "text", index, ["f"])
    assert [r.f_skills for r in found.orderBy("id").collect()] == [
        ["one"], ["one"], ["one", "three"], ["one"], ["plus"], [], [], ["dot"], ["sign"], [], [], []]
    assert "first" in found._jdf.queryExecution().optimizedPlan().toString()
