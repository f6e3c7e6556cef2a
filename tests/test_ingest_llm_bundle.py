"""Sources, gates, assemblies, model-step tables, bundle and session state."""

import json
import os
import tempfile

from conftest import SF_SMALL, one_col
from pyspark.sql import functions as F

from hirelens.functions import fixed
from hirelens.operators import recommend as R
from hirelens.plans.bundle import analyze, latest_bundles, latest_per_session, safe_score, to_json_rows, write_bundles
from hirelens.sources import ingest
from hirelens.sources import tables as T


def test_extension_and_gates(spark):
    from pathlib import Path
    names = ["a.", "a..pdf", "..pdf", ".pdf", "x.PDF", "a.b.docx", "noext", "a.tar.gz", "dir/cv.DocX"]
    got = one_col(spark, names, ingest.extension)
    assert got == [Path(n).suffix.lower() for n in names]
    df = spark.createDataFrame([("a.txt", 5), ("a.pdf", 0), ("a.docx", 3), ("a.txt", 0)], "p string, n long")
    errs = [r[0] for r in df.select(ingest.file_gate(ingest.extension("p"), F.col("n"))).collect()]
    assert errs == [fixed.ERR_UNSUPPORTED, fixed.ERR_EMPTY_FILE, None, fixed.ERR_UNSUPPORTED]


def test_binary_file_source(spark):
    d = tempfile.mkdtemp(prefix="hl-files-")
    for name, body in [("cv.pdf", b"%PDF"), ("CV2.DOCX", b"PK"), ("empty.pdf", b""), ("notes.txt", b"x")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(body)
    g = ingest.gate_files(ingest.read_files(spark, d)).select("filename", "extension", "error").collect()
    got = {r.filename: (r.extension, r.error) for r in g}
    assert got == {"cv.pdf": (".pdf", None), "CV2.DOCX": (".docx", None),
                   "empty.pdf": (".pdf", fixed.ERR_EMPTY_FILE), "notes.txt": (".txt", fixed.ERR_UNSUPPORTED)}


def test_page_and_part_assembly(spark):
    pages = spark.createDataFrame(
        [(1, 2, "second\xa0 page"), (1, 1, "first  page \n\n"), (1, 3, " \t "), (2, 1, "  ")],
        "doc_id long, page_no int, text string")
    got = {r.doc_id: r.text for r in ingest.assemble_pages(pages).collect()}
    assert got == {1: "first page\nsecond page", 2: ""}
    parts = spark.createDataFrame([
        (1, "footer", 0, 0, 0, 0, 9, "foot"), (1, "header", 0, 0, 0, 0, 9, "head"),
        (1, "cell", 0, 0, 1, 1, 0, " b "), (1, "cell", 0, 0, 1, 0, 0, "a"), (1, "cell", 0, 0, 2, 0, 0, " "),
        (1, "paragraph", 0, 0, 0, 0, 2, "p2"), (1, "paragraph", 0, 0, 0, 0, 1, "p1"),
        (1, "paragraph", 0, 0, 0, 0, 3, "  "), (1, "header", 1, 0, 0, 0, 0, "head1"),
        (2, "paragraph", 0, 0, 0, 0, 1, " "), (2, "cell", 0, 0, 1, 0, 0, "\t")],
        "doc_id long, kind string, section_no int, table_no int, row_no int, cell_no int, ord int, text string")
    got = {r.doc_id: r.text for r in ingest.assemble_parts(parts).collect()}
    assert got == {1: "p1\np2\na | b\nhead\nfoot\nhead1", 2: ""}


def test_input_gates(spark):
    df = spark.createDataFrame([(None, "job"), ("cv", "  \n"), ("cv", "job")], "r string, j string")
    got = [r[0] for r in df.select(ingest.input_gate(F.col("r"), F.col("j"))).collect()]
    assert got == [fixed.ERR_NO_RESUME, fixed.ERR_NO_JOB, None]


def _answer(**over):
    base = {"target_role": "r", "overall_assessment": "a", "required_skills": ["x"],
            "preferred_skills": [], "matched_strengths": [], "missing_requirements": [],
            "recommended_keywords": [], "tailored_summary": "s",
            "bullet_improvements": [{"original": "o", "improved": "i", "reason": "r"}] * 4,
            "evidence_checks": [{"requirement": "q", "status": "partial", "evidence": "e",
                                 "recommendation": "c"}],
            "interview_focus": [], "warnings": []}
    base.update(over)
    return json.dumps({k: v for k, v in base.items() if v is not KeyError})


def test_validation_cases(spark):
    cases = [_answer(), _answer(extra=1), _answer(warnings=KeyError), _answer(target_role=7),
             _answer(evidence_checks=[{"requirement": "q", "status": "unknown", "evidence": "e",
                                       "recommendation": "c"}]),
             _answer(required_skills=["a", None]), "", None, "{bad", "[1]",
             _answer(bullet_improvements=[{"original": "o", "improved": "i"}])]
    got = one_col(spark, cases, R.validation_error)
    assert got[:2] == [None, None]
    assert got[2] == "invalid field: warnings"
    assert got[3] == "invalid field: target_role"
    assert got[4] == "invalid field: evidence_checks"
    assert got[5] == "invalid field: required_skills"
    assert got[6] == got[7] == fixed.ERR_EMPTY_ANSWER
    assert got[8] == "invalid JSON" and got[9] == "answer is not a JSON object"
    assert got[10] == "invalid field: bullet_improvements"


def test_explode_and_errors(spark):
    df = spark.createDataFrame([(1, _answer())], "application_id int, output_text string")
    a = R.parse_responses(df)
    b = R.bullet_rows(a, ["application_id"]).collect()
    assert [r.bullet_no for r in b] == [1, 2, 3, 4]
    e = R.evidence_rows(a, ["application_id"]).collect()[0]
    assert (e.icon, e.status_label) == (fixed.STATUS_ICONS["partial"], "Partial")
    errs = ["HTTP 429", "RESOURCE_EXHAUSTED", "GEMINI_API_KEY is not configured.", "boom", None]
    assert one_col(spark, errs, R.error_class) == ["rate_limit", "rate_limit", "missing_key", "other", None]


def test_requests_never_carry_raw_text(spark):
    req = R.build_requests(T.applications(spark, SF_SMALL), T.resumes(spark, SF_SMALL), T.jobs(spark, SF_SMALL))
    assert "text" not in req.columns and "resume_text" not in req.columns
    row = req.filter(F.col("resume_id") == 0).first()
    assert "user0@example.com" not in row.prompt and fixed.TOKENS["email"] in row.prompt
    assert row.prompt.startswith("You are an expert") and row.prompt.endswith("END JOB DESCRIPTION")
    known = T.resumes(spark, SF_SMALL).select("resume_id")
    n_consent = T.applications(spark, SF_SMALL).filter("consent").join(known, "resume_id", "left_semi").count()
    assert req.count() == n_consent


def _small(spark):
    res = spark.createDataFrame([
        (1, "a.pdf", ".pdf", "python\u200b  dev\n\n\n", 20), (2, "b.txt", ".txt", "python", 6), (3, "c.docx", ".docx", " \n", 2),
        (4, "d.pdf", ".pdf", "x", 0)], "resume_id long, filename string, extension string, text string, length long")
    jobs = spark.createDataFrame([(1, "python"), (2, " \n")], "job_id long, text string")
    apps = spark.createDataFrame([
        (10, "s", 1, 1, 1), (11, "s", 2, 1, 2), (12, "t", 3, 1, 1), (13, "t", 4, 1, 2), (14, "u", 9, 1, 1), (15, "u", 1, 2, 2),
        (16, "u", 1, 1, 0)], "application_id long, session_id string, resume_id long, job_id long, ts long")
    return apps, res, jobs


def test_bundle_gates_and_clean_up(spark):
    got = {r.application_id: r for r in analyze(*_small(spark)).collect()}
    fail = fixed.ERR_ANALYSIS_PREFIX
    assert {k: r.error for k, r in got.items()} == {
        10: None, 11: fail + fixed.ERR_UNSUPPORTED, 12: fail + fixed.ERR_NO_TEXT_DOCX, 13: fail + fixed.ERR_EMPTY_FILE,
        14: fixed.ERR_NO_RESUME, 15: fixed.ERR_NO_JOB, 16: None}
    assert got[10].resume_data.characters == len("python dev") and got[10].technical_score == 100
    assert got[11].match_result is None and got[11].job_match_score is None


def test_failed_analysis_keeps_the_last_good_one(spark):
    apps, res, jobs = _small(spark)
    want = {("s", 10), ("u", 16)}
    assert {(r.session_id, r.application_id) for r in latest_bundles(apps, res, jobs).collect()} == want
    every = analyze(apps, res, jobs).select("session_id", "ts", "application_id", "job_match_score", "error")
    assert {(r.session_id, r.application_id) for r in latest_per_session(every).collect()} == want


def test_bundles_are_written_and_exported(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="hl-bundles-"), "b")
    b = analyze(*_small(spark))
    write_bundles(b, path)
    back = spark.read.parquet(path)
    assert back.columns == b.columns and back.count() == 7
    rows = to_json_rows(back.where("application_id = 10"), ["application_id"], ["ats_result", "match_result"]).collect()
    assert json.loads(rows[0].match_result)["matched_technical"] == ["Python"] and "score" in json.loads(rows[0].ats_result)


def test_safe_score(spark):
    vals = [None, -3.0, 42.5, 43.5, 150.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(safe_score(F.col("x"))).collect()] == [0, 0, 42, 44, 100]


def test_results_wrap_or_classify(spark):
    keys = "application_id long"
    answers = R.parse_responses(spark.createDataFrame(
        [(1, _answer(), None), (2, "", None), (3, _answer(), "HTTP 429")], keys + ", output_text string, error string"))
    req = spark.createDataFrame([(1, (5,)), (2, (6,)), (3, (7,))], keys + ", privacy struct<total_redactions:int>")
    got = {r.application_id: r for r in R.results(answers, req, ["application_id"]).collect()}
    assert got[1].result.model == fixed.MODEL_NAME and got[1].result.privacy.total_redactions == 5 and got[1].message is None
    assert got[2].result is None and got[2].message == fixed.ERR_LLM_PREFIX + fixed.ERR_EMPTY_ANSWER
    assert got[3].error_class == "rate_limit"


def test_request_options_hold_the_answer_schema(spark):
    req = R.build_requests(T.applications(spark, SF_SMALL), T.resumes(spark, SF_SMALL), T.jobs(spark, SF_SMALL))
    schema = json.loads(req.first().options)["response_format"]["schema"]
    assert schema["required"] == [n for n, _ in fixed.ANSWER_FIELDS]
    assert schema["properties"]["evidence_checks"]["items"]["properties"]["status"]["enum"] == fixed.EVIDENCE_STATUSES


def test_answers_are_parsed_once_whatever_is_filtered(spark):
    """Filters on the analysis stay above the parser: one parse in the plan, none beside it."""
    from hirelens.operators import recommend as R
    df = spark.range(3).selectExpr("id AS application_id", "concat('[', id, ']') AS output_text").repartition(2)
    answers = R.parse_responses(df)
    assert answers.columns == ["application_id", "output_text", "validation_error", "analysis"]
    plan = R.evidence_rows(answers.where("analysis IS NOT NULL"), ["application_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("from_json") == 1
