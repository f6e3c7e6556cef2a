"""Scorecard branches with the points written out by hand; the oracle SQL judges the
scorecard of every résumé of the fixture (test_entry)."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from hirelens.operators.scorecard import check_rows, recommendations, scorecard
from hirelens.sources import tables as T


def _card(spark, rows):
    df = spark.createDataFrame([(i, f"f{i}{e}", e, t) for i, (t, e) in enumerate(rows)],
                               "resume_id int, filename string, extension string, text string")
    return scorecard(df).orderBy("resume_id").collect()


def _points(card):
    return [c.points for c in card.checks]


def _words(n):
    return " ".join(["word"] * n)


def test_word_count_branches(spark):
    counts = [49, 50, 99, 100, 149, 150, 249, 250, 1000, 1001, 1500, 1501]
    rows = _card(spark, [(_words(n), ".pdf") for n in counts])
    assert [r.checks[0].points for r in rows] == [0, 10, 10, 20, 20, 20, 20, 20, 20, 20, 20, 20]
    assert [r.checks[10].points for r in rows] == [3, 3, 3, 3, 3, 7, 7, 10, 10, 7, 7, 3]
    # one line, readable characters, supported format, nothing else
    assert _points(rows[0]) == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 5, 5, 0]


def test_ratio_lines_dates_format(spark):
    texts = [
        ("", ".pdf"),                                   # ratio 1.0
        ("a" * 99 + "$", ".docx"),                      # ratio exactly 0.01
        ("a" * 97 + "$$$", ".txt"),                     # ratio exactly 0.03
        ("\n".join(["line"] * 3), ".PDF"),
        ("\n".join(["line"] * 4), ".pdf"),
        ("\n".join(["line"] * 7), ".pdf"),
        ("\n".join(["line"] * 8), ".pdf"),
        ("\n".join(["x" * 300] + ["l"] * 7), ".pdf"),
        ("\n".join(["x" * 301] + ["l"] * 7), ".pdf"),
        ("Started Jan 2019", ".pdf"),
        ("Jan 2019 - March 2021", ".pdf"),
        ("2018 - 2020 - 2021", ".pdf"),
        ("Professional Summary\nSKILLS:\nWork Experience\nEducation\nKey Projects\nuser@example.com", ".pdf"),
    ]
    rows = _card(spark, texts)
    assert all(r.score == sum(_points(r)) and 3 <= r.score <= 100 for r in rows)
    assert [r.checks[12].points for r in rows[:3]] == [0, 5, 3]
    assert [r.checks[11].points for r in rows[:4]] == [5, 5, 0, 5]
    assert [r.checks[13].points for r in rows[3:9]] == [0, 3, 3, 5, 5, 3]
    assert [r.checks[9].points for r in rows[9:12]] == [5, 10, 10]
    assert rows[3].checks[11].message == ".PDF is a supported format."
    assert rows[11].checks[2].passed  # a year range also passes as a phone number
    assert rows[12].missing_sections == ["certifications"]
    assert _points(rows[12])[1] == 7 and all(p > 0 for p in _points(rows[12])[4:9])


def test_messages_and_rows(spark):
    df = T.resumes(spark, SF_SMALL).withColumn("filename", F.lit("x")).select("resume_id", "filename", "extension", "text")
    card = scorecard(df).withColumn("recs", recommendations(F.col("checks"))).collect()
    for row in card:
        assert row.rating in ("Excellent", "Good", "Needs Improvement", "Poor")
        failed = [c for c in row.checks if not c.passed]
        assert all(c.message for c in failed) and len(row.recs) == len(failed)
    assert check_rows(scorecard(df), ["resume_id"]).count() == 14 * len(card)
