"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's tables (through the fixture views, which
keep every row) and returns flat, scalar columns: lists are joined with
'|' so both engines hash identical values. Integer outputs are BIGINT in
both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import char_count, clean_text, word_count
from ..operators import recommend as R
from ..operators import topk
from ..operators.catalog import alias_index, catalog_table, find_catalog_skills
from ..operators.match import analyze_match
from ..operators.redact import detect_candidate_name, header_addresses, redact, sensitive_lines
from ..operators.scorecard import (check_rows, find_sections, recommendations, scorecard,
                                   section_lists)
from ..operators.similarity import counted_terms, pair_similarity, term_frequencies, term_rows
from ..operators.skills import with_skills
from ..session import is_small, keep, shared_dir
from ..sources import ingest
from ..sources import tables as T
from . import oracle as O
from .bundle import (analyze, applied, job_features, latest_bundles, latest_of_features, prepare, resume_features,
                     store_bundles, to_json_rows, with_answers)
from .sink import read_version

Query = Callable[[SparkSession, str], DataFrame]


def _resumes(spark, sf):
    r = T.resumes(spark, sf)
    return r.withColumn("filename", F.concat(F.lit("resume_"), F.col("resume_id").cast("string"),
                                             F.col("extension")))


def _joined(col: str) -> F.Column:
    return F.array_join(F.col(col), "|")


def _long(c: F.Column) -> F.Column:
    return c.cast("long")


# ---------------------------------------------------------------------------
# Extraction and text statistics
# ---------------------------------------------------------------------------
def extract_stats(spark, sf):
    r = T.resumes(spark, sf).select("resume_id", "extension", clean_text("text").alias("clean"))
    return r.select("resume_id", _long(char_count("clean")).alias("characters"),
                    _long(word_count("clean")).alias("words"),
                    ingest.no_text_error(F.col("extension"), F.col("clean")).alias("error"),
                    F.sha2(F.col("clean"), 256).alias("text_sha"))


def text_predicates(spark, sf):
    from ..functions import text as X
    r = T.resumes(spark, sf)
    lines = X.nonblank_stripped_lines("text")
    return r.select("resume_id", X.has_email("text").alias("email"),
                    X.has_phone("text").alias("phone"),
                    X.has_profile_link("text").alias("link"),
                    _long(X.date_count("text")).alias("dates"),
                    X.unusual_ratio("text").alias("ratio"),
                    _long(F.size(lines)).alias("n_lines"),
                    _long(F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))).alias("longest"))


# ---------------------------------------------------------------------------
# Skills, similarity, match
# ---------------------------------------------------------------------------
def resume_skills(spark, sf):
    r = with_skills(T.resumes(spark, sf).select("resume_id", "text"), "text")
    return r.select("resume_id", _joined("technical_skills").alias("technical_skills"),
                    _joined("soft_skills").alias("soft_skills"))


def job_skills(spark, sf):
    j = with_skills(T.jobs(spark, sf).select("job_id", "text"), "text")
    return j.select("job_id", _joined("technical_skills").alias("technical_skills"),
                    _joined("soft_skills").alias("soft_skills"))


def catalog_skills(spark, sf):
    """Skills by a catalog table: the fixed catalog and phrases of the benchmark texts."""
    rows = catalog_table(spark, "technical", fixed.TECHNICAL_SKILLS).unionByName(T.view(spark, sf, "v_catalog"))
    found = find_catalog_skills(T.resumes(spark, sf), "resume_id", "text", alias_index(rows), ["technical", "phrase"])
    return found.select("resume_id", _joined("technical_skills").alias("technical_skills"),
                        _joined("phrase_skills").alias("phrase_skills"))


def term_frequency(spark, sf):
    tf = term_frequencies(T.resumes(spark, sf), "resume_id", "text")
    return tf.select(F.col("id").alias("resume_id"), "term", "tf", "sq")


def similarity(spark, sf):
    r, j, a = T.resumes(spark, sf), T.jobs(spark, sf), T.applications(spark, sf)
    terms = keep(j.select("job_id", counted_terms("text").alias("c")).select("job_id", "c.terms", "c.sq"), "job-terms")
    return pair_similarity(a, term_frequencies(r, "resume_id", "text"), term_rows(terms, "job_id"),
                           is_small(terms, F.size("terms") + 1))


TOP_JOBS = 5


def best_jobs(spark, sf):
    """The five most similar jobs of every résumé, out of all jobs."""
    def terms(df, id_col):
        return df.select(id_col, counted_terms("text").alias("c")).select(id_col, "c.terms", "c.sq")

    resumes, jobs = terms(T.resumes(spark, sf), "resume_id"), keep(terms(T.jobs(spark, sf), "job_id"), "terms")
    if is_small(jobs, limit=topk.DIRECT_JOBS) and is_small(jobs, F.size("terms") + 1):
        best = topk.direct_best_jobs(resumes, jobs, TOP_JOBS)
    else:
        best = topk.best_jobs(keep(resumes, "terms"), jobs, TOP_JOBS)
    return best.withColumn("rank", _long(F.col("rank")))


_LISTS = ["job_technical_skills", "resume_technical_skills", "matched_technical",
          "missing_technical", "job_soft_skills", "resume_soft_skills", "matched_soft", "missing_soft"]


def match(spark, sf):
    m = analyze_match(T.applications(spark, sf), T.resumes(spark, sf), T.jobs(spark, sf))
    return m.select("resume_id", "job_id", "overall_score", "technical_score",
                    "soft_skill_score", "similarity_score", *[_joined(c).alias(c) for c in _LISTS])


# ---------------------------------------------------------------------------
# Scorecard
# ---------------------------------------------------------------------------
def sections(spark, sf):
    r = T.resumes(spark, sf).select("resume_id", find_sections("text").alias("s"))
    return r.select("resume_id", *[F.col(f"s.{n}").alias(n) for n in fixed.SECTION_NAMES])


def _card(spark, sf):
    return scorecard(_resumes(spark, sf).select("resume_id", "filename", "extension", "text"))


def ats_scorecard(spark, sf):
    c = _card(spark, sf)
    return c.select("resume_id", _long(F.col("score")).alias("score"), "rating",
                    _long(F.col("word_count")).alias("word_count"),
                    F.array_join(F.transform("checks", lambda x: x["points"].cast("string")), ",")
                     .alias("points"),
                    F.array_join(F.transform("checks", lambda x: x["message"]), "|").alias("messages"),
                    F.array_join("missing_sections", ",").alias("missing_sections"))


def ats_checks(spark, sf):
    c = check_rows(_card(spark, sf), ["resume_id"])
    return c.select("resume_id", _long(F.col("check_no")).alias("check_no"), "name",
                    _long(F.col("points")).alias("points"), _long(F.col("maximum")).alias("maximum"),
                    "passed", "message", "icon", "points_label")


def ats_display(spark, sf):
    c = _card(spark, sf)
    found, miss = section_lists(F.col("sections"))
    return c.select("resume_id", F.array_join(found, "|").alias("found_sections"),
                    F.array_join(miss, "|").alias("missing_display"),
                    F.array_join(recommendations(F.col("checks")), "|").alias("recommendations"))


# ---------------------------------------------------------------------------
# Redaction
# ---------------------------------------------------------------------------
def candidate_name(spark, sf):
    r = T.resumes(spark, sf)
    return r.select("resume_id", detect_candidate_name("text").alias("candidate_name"))


def header_redaction(spark, sf):
    r = T.resumes(spark, sf)
    x = r.select("resume_id", header_addresses(F.col("text")).alias("a"))
    x = x.select("resume_id", F.col("a.n").alias("address_count"), sensitive_lines(F.col("a.text")).alias("s"))
    return x.select("resume_id", _long(F.col("address_count")).alias("address_count"),
                    _long(F.col("s.n")).alias("sensitive_count"), F.sha2(F.col("s.text"), 256).alias("text_sha"))


def redaction(spark, sf):
    r = redact(T.resumes(spark, sf).select("resume_id", "text"), "text")
    return r.select("resume_id", F.sha2("redacted_text", 256).alias("text_sha"),
                    *[_long(F.col(f"redactions.{k}")).alias(k) for k in fixed.REDACTION_KEYS],
                    _long(F.col("total_redactions")).alias("total_redactions"),
                    "candidate_name_detected")


# ---------------------------------------------------------------------------
# Ingestion
# ---------------------------------------------------------------------------
def file_gates(spark, sf):
    f = T.view(spark, sf, "v_files").withColumn("length", F.octet_length("body"))
    g = ingest.gate_files(f, "path", "length")
    return g.select("file_id", "filename", "extension", _long(F.col("length")).alias("length"), "error")


def page_assembly(spark, sf):
    d = ingest.assemble_pages(T.view(spark, sf, "v_pages_text"))
    return d.select("doc_id", _long(char_count("text")).alias("characters"),
                    _long(word_count("text")).alias("words"),
                    ingest.no_text_error(F.lit(".pdf"), F.col("text")).alias("error"),
                    F.sha2("text", 256).alias("text_sha"))


def part_assembly(spark, sf):
    d = ingest.assemble_parts(T.parts(spark, sf))
    return d.select("doc_id", _long(char_count("text")).alias("characters"),
                    _long(word_count("text")).alias("words"),
                    ingest.no_text_error(F.lit(".docx"), F.col("text")).alias("error"),
                    F.sha2("text", 256).alias("text_sha"))


def input_gates(spark, sf):
    """Gates of the applications whose résumés are the assembled page texts."""
    pages = ingest.assemble_pages(T.view(spark, sf, "v_pages_text"))
    res = pages.select(F.col("doc_id").alias("resume_id"),
                       ingest.no_text_error(F.lit(".pdf"), F.col("text")).alias("error"))
    return applied(T.applications(spark, sf), res, T.jobs(spark, sf)).select("application_id", "error")


def resume_gates(spark, sf):
    """Gates, clean-up and extraction record of every uploaded résumé."""
    r = prepare(_uploads(spark, sf))
    return r.select("resume_id", "error", _long(F.col("characters")).alias("characters"),
                    _long(F.col("words")).alias("words"), F.sha2("text", 256).alias("text_sha"))


# ---------------------------------------------------------------------------
# Bundle and session state
# ---------------------------------------------------------------------------
def _uploads(spark, sf):
    """Uploaded documents: résumés with their size; every 29th file is empty."""
    r = _resumes(spark, sf)
    return r.withColumn("length", F.when(F.col("resume_id") % 29 == 3, 0).otherwise(F.octet_length("text")))


_SCORES = ["job_match_score", "technical_score", "similarity_score", "ats_score"]


def bundle(spark, sf):
    b = analyze(T.applications(spark, sf), _uploads(spark, sf), T.jobs(spark, sf))
    return b.select("application_id", "session_id", "resume_id", "job_id",
                    *[_long(F.col(c)).alias(c) for c in _SCORES],
                    F.col("match_result.overall_score").alias("overall_score"),
                    F.col("ats_result.rating").alias("rating"),
                    _long(F.col("resume_data.characters")).alias("characters"), "error")


def latest_bundle(spark, sf):
    b = latest_bundles(T.applications(spark, sf), _uploads(spark, sf), T.jobs(spark, sf))
    return b.select("session_id", "application_id", "resume_id", "job_id",
                    *[_long(F.col(c)).alias(c) for c in _SCORES])


def session_state(spark, sf):
    """The bundles as a sink holds them, with the model's answers: written twice, the second time
    with all applications, read back, and an answer to an earlier application is gone."""
    apps = T.applications(spark, sf)
    path = f"{shared_dir(spark)}/session-state-{uuid.uuid4().hex}"
    rf, jf = keep(resume_features(_uploads(spark, sf)), "resume-features"), keep(job_features(T.jobs(spark, sf)), "job-features")
    for some in (apps.where("application_id % 2 = 0"), apps):
        store_bundles(latest_of_features(some, rf, jf), path)
    told = _answers(spark, sf).where("analysis IS NOT NULL AND error IS NULL").select(
        "application_id", F.col("analysis.target_role").alias("result")).join(apps.select("application_id", "session_id"), "application_id")
    b = with_answers(read_version(spark, path), told)
    return b.select("session_id", "application_id", *[_long(F.col(c)).alias(c) for c in _SCORES], F.col("result").alias("target_role"))


def json_export(spark, sf):
    """The shown JSON documents: scorecard without its checks, and redaction counts."""
    card = _card(spark, sf)
    red = redact(card, "text").select("resume_id", F.struct("score", "rating", "word_count", "missing_sections", "filename").alias("ats"), "redactions")
    return to_json_rows(red, ["resume_id"], ["ats", "redactions"])


def file_inventory(spark, sf):
    """The uploaded files' bodies written to folders, listed by prefix and read back."""
    files = T.view(spark, sf, "v_files").select((F.col("file_id") % 16).cast("int").alias("folder"), F.coalesce("body", F.lit("")).alias("value"))
    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    files.repartition("folder").write.partitionBy("folder").text(at)
    uri = at if ":" in at.split("/")[0] else f"file://{at}"
    prefixes = spark.range(16).select(F.concat(F.lit(f"{uri}/folder="), F.col("id")).alias("prefix"))
    listed = ingest.list_files(prefixes).where(F.col("path").rlike(r"/part-[^/]*$"))
    per = listed.groupBy(F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long").alias("folder")).agg(F.sum("length").alias("bytes"))
    held = ingest.read_files(spark, at, inventory=listed).groupBy(
        F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long").alias("folder")).agg(F.sum(F.octet_length("content")).cast("long").alias("content_bytes"))
    return per.join(held, "folder")


# ---------------------------------------------------------------------------
# Language-model step (table side)
# ---------------------------------------------------------------------------
def llm_requests(spark, sf):
    req = R.build_requests(T.applications(spark, sf), T.resumes(spark, sf), T.jobs(spark, sf))
    return req.select("application_id", "resume_id", "job_id", "model",
                      F.sha2("prompt", 256).alias("prompt_sha"),
                      _long(F.length("prompt")).alias("prompt_chars"),
                      _long(F.col("privacy.total_redactions")).alias("total_redactions"))


def _answers(spark, sf, analysis=True):
    return R.parse_responses(T.llm_responses(spark, sf), analysis=analysis)


def llm_validation(spark, sf):
    return _answers(spark, sf, analysis=False).select("application_id", "validation_error")


def llm_bullets(spark, sf):
    b = R.bullet_rows(_answers(spark, sf).filter(F.col("analysis").isNotNull()), ["application_id"])
    return b.withColumn("bullet_no", _long(F.col("bullet_no")))


def llm_evidence(spark, sf):
    e = R.evidence_rows(_answers(spark, sf).filter(F.col("analysis").isNotNull()), ["application_id"])
    return e.withColumn("check_no", _long(F.col("check_no")))


def llm_display(spark, sf):
    a = _answers(spark, sf).filter(F.col("analysis").isNotNull())
    keys = ["required_skills", "preferred_skills", "matched_strengths", "missing_requirements",
            "recommended_keywords", "interview_focus"]
    return a.select("application_id", F.col("analysis.target_role").alias("target_role"),
                    *[F.array_join(R.list_or_default(F.col(f"analysis.{k}"), k), "|").alias(k)
                      for k in keys],
                    _long(F.size("analysis.warnings")).alias("n_warnings"))


def llm_errors(spark, sf):
    a = _answers(spark, sf, analysis=False)
    err = R.call_error("error", "validation_error")
    return a.select("application_id", R.error_class(err).alias("error_class"), R.error_message(err).alias("message"))


def llm_result(spark, sf):
    """Requests joined to their answers: wrapped result or classified error."""
    a = T.applications(spark, sf)
    jobs = T.jobs(spark, sf)
    documents = R.resume_prompts(T.resumes(spark, sf), a.where("consent").select("resume_id").distinct())
    req = R.request_rows(a, documents, jobs)        # by reference: no prompt is needed here
    r = R.results(_answers(spark, sf), req, ["application_id"])
    return r.select("application_id", F.col("result.model").alias("model"),
                    F.col("result.analysis.target_role").alias("target_role"),
                    _long(F.col("result.privacy.total_redactions")).alias("total_redactions"),
                    "error_class", "message")


QUERIES: dict[str, Query] = {
    "extract_stats": extract_stats,
    "text_predicates": text_predicates,
    "resume_skills": resume_skills,
    "job_skills": job_skills,
    "catalog_skills": catalog_skills,
    "term_frequency": term_frequency,
    "similarity": similarity,
    "best_jobs": best_jobs,
    "match": match,
    "sections": sections,
    "ats_scorecard": ats_scorecard,
    "ats_checks": ats_checks,
    "ats_display": ats_display,
    "candidate_name": candidate_name,
    "header_redaction": header_redaction,
    "redaction": redaction,
    "file_gates": file_gates,
    "page_assembly": page_assembly,
    "part_assembly": part_assembly,
    "input_gates": input_gates,
    "resume_gates": resume_gates,
    "bundle": bundle,
    "latest_bundle": latest_bundle,
    "session_state": session_state,
    "json_export": json_export,
    "file_inventory": file_inventory,
    "llm_requests": llm_requests,
    "llm_validation": llm_validation,
    "llm_bullets": llm_bullets,
    "llm_evidence": llm_evidence,
    "llm_display": llm_display,
    "llm_errors": llm_errors,
    "llm_result": llm_result,
}


# ===========================================================================
# Oracle SQL (DuckDB)
# ===========================================================================
def _lit(s):
    return O.lit(s)


def _sq_extract_stats():
    clean = O.clean_text("text")
    return f"""
SELECT resume_id, CAST(length(clean) AS BIGINT) AS characters, {O.word_count('clean')} AS words,
       CASE WHEN clean = '' THEN CASE WHEN extension = '.pdf' THEN {_lit(fixed.ERR_NO_TEXT_PDF)}
            ELSE {_lit(fixed.ERR_NO_TEXT_DOCX)} END END AS error,
       sha256(clean) AS text_sha
FROM (SELECT resume_id, extension, {clean} AS clean FROM {O.v('v_resumes')})"""


def _sq_text_predicates():
    return f"""WITH {O.features_cte(O.v('v_resumes'))}
SELECT resume_id, email, phone, link, dates, ratio, n_lines, longest FROM feat"""


# NFKC + casefold for the characters the views plant beyond ASCII (full-width letters).
_NORM = "translate(lower(text), 'ｐｙｔｈｏｎｓｑｌ', 'pythonsql')"


def _sq_skills(view, id_col):
    return f"""
SELECT {id_col}, array_to_string({O.skill_list(_NORM, fixed.TECHNICAL_SKILLS)}, '|') AS technical_skills,
       array_to_string({O.skill_list(_NORM, fixed.SOFT_SKILLS)}, '|') AS soft_skills
FROM {O.v(view)}"""


def _sq_catalog_skills():
    pattern = _lit(f"(?:^|{O.NOT_EDGE})") + " || regexp_escape(lower(c.alias)) || " + _lit(f"(?:$|{O.NOT_EDGE})")
    return f"""WITH r AS (SELECT resume_id, text, {_NORM} AS norm FROM {O.v('v_resumes')}),
hit AS (SELECT DISTINCT r.resume_id, c.skill FROM r JOIN {O.v('v_catalog')} c ON contains(r.norm, lower(c.alias))
        WHERE regexp_matches(r.norm, {pattern}))
SELECT r.resume_id, coalesce(array_to_string({O.skill_list('norm', fixed.TECHNICAL_SKILLS)}, '|'), '') AS technical_skills,
       coalesce((SELECT string_agg(skill, '|' ORDER BY skill) FROM hit WHERE hit.resume_id = r.resume_id), '') AS phrase_skills
FROM r"""


def _sq_term_frequency():
    return f"""WITH {O.terms_cte('rt', O.v('v_resumes'), 'resume_id')}
SELECT id AS resume_id, term, tf, CAST(sum(tf * tf) OVER (PARTITION BY id) AS BIGINT) AS sq FROM rt"""


def _sim_ctes(res=None, apps=None):
    """Cosine of the two idf-weighted count vectors of each pair: weights and norms from the
    definition (idf = 1 + ln(3 / (1 + documents with the term)) over the pair's two documents)."""
    idf = "(1 + ln(CAST(3 AS DOUBLE) / (1 + {n})))"
    one, two = idf.format(n=1), idf.format(n=2)
    return f"""a AS (SELECT * FROM {apps or O.v('v_applications')}),
p AS (SELECT DISTINCT resume_id, job_id FROM a),
{O.terms_cte('rt', res or O.v('v_resumes'), 'resume_id')},
{O.terms_cte('jt', O.v('v_jobs'), 'job_id')},
rv AS (SELECT p.resume_id, p.job_id, sqrt(sum(power(rt.tf * CASE WHEN jt.term IS NULL THEN {one} ELSE {two} END, 2))) AS norm,
              sum(CASE WHEN jt.term IS NULL THEN 0 ELSE rt.tf * {two} * jt.tf * {two} END) AS dot
       FROM p JOIN rt ON rt.id = p.resume_id LEFT JOIN jt ON jt.id = p.job_id AND jt.term = rt.term
       GROUP BY p.resume_id, p.job_id),
jv AS (SELECT p.resume_id, p.job_id, sqrt(sum(power(jt.tf * CASE WHEN rt.term IS NULL THEN {one} ELSE {two} END, 2))) AS norm
       FROM p JOIN jt ON jt.id = p.job_id LEFT JOIN rt ON rt.id = p.resume_id AND rt.term = jt.term
       GROUP BY p.resume_id, p.job_id),
sim AS (SELECT p.resume_id, p.job_id,
               CASE WHEN coalesce(dot, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * dot / (rv.norm * jv.norm), 2) END
                 AS similarity_score
        FROM p LEFT JOIN rv ON rv.resume_id = p.resume_id AND rv.job_id = p.job_id
               LEFT JOIN jv ON jv.resume_id = p.resume_id AND jv.job_id = p.job_id)"""


def _sq_similarity():
    return f"WITH {_sim_ctes()}\nSELECT resume_id, job_id, similarity_score FROM sim"


def _sq_best_jobs():
    pairs = f"(SELECT resume_id, job_id FROM (SELECT resume_id FROM {O.v('v_resumes')}) CROSS JOIN (SELECT job_id FROM {O.v('v_jobs')}))"
    return f"""WITH {_sim_ctes(apps=pairs)}
SELECT resume_id, job_id, similarity_score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY similarity_score DESC, job_id) AS rank
      FROM sim WHERE similarity_score > 0)
WHERE rank <= {TOP_JOBS}"""


def _pct(req, res):
    x = f"(len(list_intersect({req}, {res})) / len({req}) * CAST(100 AS DOUBLE))"
    return f"CASE WHEN len({req}) = 0 THEN CAST(0 AS DOUBLE) ELSE {O.py_round2(x)} END"


def _match_ctes(res=None, apps=None):
    tech, soft = fixed.TECHNICAL_SKILLS, fixed.SOFT_SKILLS
    acc = ("((CASE WHEN len(jt_sk) > 0 THEN technical_score * CAST(55 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
           " + CASE WHEN len(js_sk) > 0 THEN soft_skill_score * CAST(15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
           " + similarity_score * CAST(30 AS DOUBLE))")
    w = "(CASE WHEN len(jt_sk) > 0 THEN 55 ELSE 0 END + CASE WHEN len(js_sk) > 0 THEN 15 ELSE 0 END + 30)"
    return f"""{_sim_ctes(res, apps)},
rsk AS (SELECT resume_id, {O.skill_list(_NORM, tech)} AS rt_sk,
               {O.skill_list(_NORM, soft)} AS rs_sk FROM {res or O.v('v_resumes')}),
jsk AS (SELECT job_id, {O.skill_list(_NORM, tech)} AS jt_sk,
               {O.skill_list(_NORM, soft)} AS js_sk FROM {O.v('v_jobs')}),
m0 AS (SELECT sim.resume_id, sim.job_id, sim.similarity_score, jt_sk, rt_sk, js_sk, rs_sk,
              {_pct('jt_sk', 'rt_sk')} AS technical_score, {_pct('js_sk', 'rs_sk')} AS soft_skill_score
       FROM sim JOIN rsk ON rsk.resume_id = sim.resume_id JOIN jsk ON jsk.job_id = sim.job_id),
m AS (SELECT *, {O.py_round2(f'{acc} / CAST({w} AS DOUBLE)')} AS overall_score FROM m0)"""


def _sq_match():
    return f"""WITH {_match_ctes()}
SELECT resume_id, job_id, overall_score, technical_score, soft_skill_score, similarity_score,
       array_to_string(jt_sk, '|') AS job_technical_skills,
       array_to_string(rt_sk, '|') AS resume_technical_skills,
       array_to_string(list_sort(list_intersect(jt_sk, rt_sk)), '|') AS matched_technical,
       array_to_string(list_sort(list_filter(jt_sk, lambda s: NOT list_contains(rt_sk, s))), '|') AS missing_technical,
       array_to_string(js_sk, '|') AS job_soft_skills,
       array_to_string(rs_sk, '|') AS resume_soft_skills,
       array_to_string(list_sort(list_intersect(js_sk, rs_sk)), '|') AS matched_soft,
       array_to_string(list_sort(list_filter(js_sk, lambda s: NOT list_contains(rs_sk, s))), '|') AS missing_soft
FROM m"""


def _sq_sections():
    heads = O.heading_lines("text")
    return f"""
SELECT resume_id, {O.section_flags('heads')}
FROM (SELECT resume_id, {heads} AS heads FROM {O.v('v_resumes')})"""


def _card_ctes():
    src = (f"(SELECT resume_id, extension, text FROM {O.v('v_resumes')})")
    return f"{O.features_cte(src)},\n{O.score_cte()}"


def _sq_scorecard():
    return f"""WITH {_card_ctes()}
SELECT resume_id, score, {O.rating('score')} AS rating, word_count,
       array_to_string(list_transform(pts, lambda p: CAST(p AS VARCHAR)), ',') AS points,
       array_to_string(msgs, '|') AS messages, missing_sections
FROM card"""


def _sq_checks():
    return f"""WITH {_card_ctes()}
SELECT resume_id, CAST(i AS BIGINT) AS check_no, names[i] AS name, CAST(pts[i] AS BIGINT) AS points,
       CAST(maxima[i] AS BIGINT) AS maximum, pts[i] = maxima[i] AS passed, msgs[i] AS message,
       CASE WHEN pts[i] = maxima[i] THEN {_lit(fixed.CHECK_ICON_PASSED)} ELSE {_lit(fixed.CHECK_ICON_FAILED)} END AS icon,
       CAST(pts[i] AS VARCHAR) || '/' || CAST(maxima[i] AS VARCHAR) AS points_label
FROM (SELECT *, unnest(range(1, 15)) AS i FROM card)"""


def _sq_display():
    found = " || ".join(f"CASE WHEN {n} THEN {_lit(n.title() + '|')} ELSE '' END" for n in fixed.SECTION_NAMES)
    miss = " || ".join(f"CASE WHEN NOT {n} THEN {_lit(n.title() + '|')} ELSE '' END" for n in fixed.SECTION_NAMES)
    return f"""WITH {_card_ctes()}
SELECT resume_id, rtrim({found}, '|') AS found_sections, rtrim({miss}, '|') AS missing_display,
       array_to_string(list_filter(list_transform(range(1, 15), lambda i: CASE WHEN pts[i] <> maxima[i]
            AND msgs[i] <> '' THEN msgs[i] END), lambda x: x IS NOT NULL), '|') AS recommendations
FROM card"""


def _sq_candidate_name():
    return f"SELECT resume_id, {O.name_candidate('text')} AS candidate_name FROM {O.v('v_resumes')}"


def _sq_header_redaction():
    lines = O.splitlines("text")
    addr_text = (f"array_to_string(list_transform({lines}, lambda l, i: CASE WHEN i <= 12 AND "
                 f"{O.address_line('l')} THEN {_lit(fixed.TOKENS['address'])} ELSE l END), chr(10))")
    n_addr = f"CAST(len(list_filter(list_slice({lines}, 1, 12), lambda l: {O.address_line('l')})) AS BIGINT)"
    sens = f"regexp_matches(l, {_lit(O.SENSITIVE)})"
    lines2 = O.splitlines("t1")
    return f"""
SELECT resume_id, address_count,
       CAST(len(list_filter({lines2}, lambda l: {sens})) AS BIGINT) AS sensitive_count,
       sha256(array_to_string(list_transform({lines2}, lambda l: CASE WHEN {sens}
              THEN {_lit(fixed.TOKENS['sensitive_fields'])} ELSE l END), chr(10))) AS text_sha
FROM (SELECT resume_id, {addr_text} AS t1, {n_addr} AS address_count FROM {O.v('v_resumes')})"""


def _gate_sql(ext, size):
    return (f"CASE WHEN {ext} NOT IN ('.pdf', '.docx') THEN {_lit(fixed.ERR_UNSUPPORTED)} "
            f"WHEN {size} = 0 THEN {_lit(fixed.ERR_EMPTY_FILE)} END")


def _sq_file_gates():
    return f"""
SELECT file_id, filename, extension, length, {_gate_sql('extension', 'length')} AS error
FROM (SELECT file_id, filename, lower(coalesce(regexp_extract(filename, '[^/](\\.[^./]+)$', 1), '')) AS extension,
             CAST(octet_length(encode(body)) AS BIGINT) AS length
      FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename FROM {O.v('v_files')}))"""


def _pages_cte():
    return f"""pg AS (
  SELECT doc_id, {O.clean_text("coalesce(string_agg(CASE WHEN " + O.strip('text') + " <> '' THEN text END, chr(10) ORDER BY page_no), '')")} AS text
  FROM {O.v('v_pages_text')} GROUP BY doc_id)"""


def _sq_page_assembly():
    return f"""WITH {_pages_cte()}
SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, {O.word_count('text')} AS words,
       CASE WHEN text = '' THEN {_lit(fixed.ERR_NO_TEXT_PDF)} END AS error, sha256(text) AS text_sha
FROM pg"""


def _sq_part_assembly():
    rows = f"""SELECT doc_id, 1 AS rnk, table_no AS k1, row_no AS k2, 0 AS k3,
        coalesce(string_agg(CASE WHEN {O.strip('text')} <> '' THEN {O.strip('text')} END, ' | ' ORDER BY cell_no), '') AS text
      FROM parts WHERE kind = 'cell' GROUP BY doc_id, table_no, row_no"""
    other = """SELECT doc_id, CASE WHEN kind = 'paragraph' THEN 0 ELSE 2 END, CASE WHEN kind = 'paragraph' THEN 0 ELSE section_no END,
        CASE WHEN kind = 'footer' THEN 1 ELSE 0 END, ord, text FROM parts WHERE kind <> 'cell'"""
    agg = f"coalesce(string_agg(CASE WHEN {O.strip('text')} <> '' THEN text END, chr(10) ORDER BY rnk, k1, k2, k3), '')"
    return f"""WITH parts AS ({T.PARTS_SQL}),
allp AS ({rows} UNION ALL {other}),
d AS (SELECT doc_id, {O.clean_text(agg)} AS text FROM allp GROUP BY doc_id)
SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, {O.word_count('text')} AS words,
       CASE WHEN text = '' THEN {_lit(fixed.ERR_NO_TEXT_DOCX)} END AS error, sha256(text) AS text_sha FROM d"""


def _sq_input_gates():
    return f"""WITH {_pages_cte()},
a AS (SELECT * FROM {O.v('v_applications')}),
j AS (SELECT job_id, text AS job_text FROM {O.v('v_jobs')})
SELECT a.application_id,
       coalesce(CASE WHEN pg.text IS NULL THEN {_lit(fixed.ERR_NO_RESUME)}
                     WHEN coalesce({O.strip('j.job_text')}, '') = '' THEN {_lit(fixed.ERR_NO_JOB)} END,
                CASE WHEN pg.text = '' THEN {_lit(fixed.ERR_ANALYSIS_PREFIX + fixed.ERR_NO_TEXT_PDF)} END) AS error
FROM a LEFT JOIN pg ON pg.doc_id = a.resume_id LEFT JOIN j ON j.job_id = a.job_id"""


def _records_sql():
    """Gated and cleaned uploads: (resume_id, extension, text, error)."""
    gate = _gate_sql("extension", "size")
    return f"""(SELECT resume_id, extension, gate, clean AS text, coalesce(gate, CASE WHEN clean = '' THEN
       CASE WHEN extension = '.pdf' THEN {_lit(fixed.ERR_NO_TEXT_PDF)} ELSE {_lit(fixed.ERR_NO_TEXT_DOCX)} END END) AS error
FROM (SELECT resume_id, extension, {gate} AS gate, {O.clean_text('text')} AS clean
      FROM (SELECT *, CASE WHEN resume_id % 29 = 3 THEN 0 ELSE octet_length(encode(text)) END AS size FROM {O.v('v_resumes')})))"""


def _sq_resume_gates():
    return f"""
SELECT resume_id, error, CASE WHEN gate IS NULL THEN CAST(length(text) AS BIGINT) END AS characters,
       CASE WHEN gate IS NULL THEN {O.word_count('text')} END AS words,
       CASE WHEN gate IS NULL THEN sha256(text) END AS text_sha
FROM {_records_sql()}"""


def _bundle_ctes():
    apps = f"""(SELECT a0.*, coalesce(
           CASE WHEN rec.resume_id IS NULL THEN {_lit(fixed.ERR_NO_RESUME)}
                WHEN coalesce({O.strip('j0.text')}, '') = '' THEN {_lit(fixed.ERR_NO_JOB)} END,
           {_lit(fixed.ERR_ANALYSIS_PREFIX)} || rec.error) AS error
      FROM {O.v('v_applications')} a0 LEFT JOIN rec ON rec.resume_id = a0.resume_id
           LEFT JOIN {O.v('v_jobs')} j0 ON j0.job_id = a0.job_id)"""
    good = "(SELECT resume_id, extension, text FROM rec WHERE error IS NULL)"
    return f"""rec AS {_records_sql()},
apps AS {apps},
{_match_ctes(good, '(SELECT * FROM apps WHERE error IS NULL)')},
{O.features_cte(good)},
{O.score_cte()},
b AS (SELECT apps.application_id, apps.session_id, apps.resume_id, apps.job_id, apps.ts, apps.error,
             CAST(least(100, greatest(0, round_even(m.overall_score, 0))) AS BIGINT) AS job_match_score,
             CAST(least(100, greatest(0, round_even(m.technical_score, 0))) AS BIGINT) AS technical_score,
             CAST(least(100, greatest(0, round_even(m.similarity_score, 0))) AS BIGINT) AS similarity_score,
             CAST(least(100, greatest(0, card.score)) AS BIGINT) AS ats_score,
             m.overall_score, CASE WHEN apps.error IS NULL THEN {O.rating('card.score')} END AS rating,
             CASE WHEN apps.error IS NULL THEN CAST(length(rec.text) AS BIGINT) END AS characters
      FROM apps LEFT JOIN m ON apps.error IS NULL AND m.resume_id = apps.resume_id AND m.job_id = apps.job_id
             LEFT JOIN card ON apps.error IS NULL AND card.resume_id = apps.resume_id
             LEFT JOIN rec ON rec.resume_id = apps.resume_id)"""


def _scores_sql():
    return ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in _SCORES)


def _sq_bundle():
    return f"""WITH {_bundle_ctes()}
SELECT application_id, session_id, resume_id, job_id, {_scores_sql()},
       overall_score, rating, characters, error FROM b"""


def _sq_latest_bundle():
    return f"""WITH {_bundle_ctes()}
SELECT session_id, application_id, resume_id, job_id, {', '.join(_SCORES)}
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, application_id DESC) AS rn FROM b WHERE error IS NULL)
WHERE rn = 1"""


def _sq_session_state():
    """Answers count only for the session's last application."""
    return f"""WITH {_bundle_ctes()},
{_answers_cte()},
last AS (SELECT session_id, application_id, {', '.join(_SCORES)}
         FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, application_id DESC) AS rn FROM b WHERE error IS NULL)
         WHERE rn = 1)
SELECT last.*, json_extract_string(ok.output_text, '$.target_role') AS target_role
FROM last LEFT JOIN ok ON ok.application_id = last.application_id AND ok.error IS NULL"""


def _sq_json_export():
    counts = " || ',' || ".join(f"""'"{k}":' || CAST(c_{k} AS VARCHAR)""" for k in fixed.REDACTION_KEYS)
    missing = """'[' || CASE WHEN missing_sections = '' THEN '' ELSE '"' || replace(missing_sections, ',', '","') || '"' END || ']'"""
    return f"""WITH {_card_ctes()},
{O.redaction_ctes(O.v('v_resumes'))}
SELECT card.resume_id, '{{"score":' || CAST(score AS VARCHAR) || ',"rating":"' || {O.rating('score')} || '","word_count":' || CAST(word_count AS VARCHAR)
       || ',"missing_sections":' || {missing} || ',"filename":"resume_' || CAST(card.resume_id AS VARCHAR) || card.extension || '"}}' AS ats,
       '{{' || {counts} || '}}' AS redactions
FROM card JOIN red ON red.resume_id = card.resume_id"""


def _sq_file_inventory():
    return f"""SELECT file_id % 16 AS folder, CAST(sum(octet_length(encode(coalesce(body, ''))) + 1) AS BIGINT) AS bytes,
       CAST(sum(octet_length(encode(coalesce(body, ''))) + 1) AS BIGINT) AS content_bytes
FROM {O.v('v_files')} GROUP BY 1"""


def _valid_sql(t):
    def s(path, base=t):
        return f"coalesce(json_type({base}, {_lit(path)}) = 'VARCHAR', false)"

    def strings(path):
        return (f"coalesce(json_type({t}, {_lit(path)}) = 'ARRAY' AND coalesce(list_bool_and(list_transform("
                f"json_extract({t}, {_lit(path + '[*]')}), lambda e: json_type(e) = 'VARCHAR')), true), false)")

    def objects(path, fields, status=False):
        cond = " AND ".join([f"json_type(e) = 'OBJECT'"] + [s(f'$.{f}', 'e') for f in fields])
        if status:
            cond += " AND coalesce(json_extract_string(e, '$.status') IN ('matched', 'partial', 'missing'), false)"
        return (f"coalesce(json_type({t}, {_lit(path)}) = 'ARRAY' AND coalesce(list_bool_and(list_transform("
                f"json_extract({t}, {_lit(path + '[*]')}), lambda e: {cond})), true), false)")

    parts = [f"WHEN {t} IS NULL OR {t} = '' THEN {_lit(fixed.ERR_EMPTY_ANSWER)}",
             f"WHEN NOT json_valid({t}) THEN 'invalid JSON'",
             f"WHEN json_type({t}) <> 'OBJECT' THEN 'answer is not a JSON object'"]
    for name, kind in fixed.ANSWER_FIELDS:
        p = f"$.{name}"
        ok = (s(p) if kind == "string" else strings(p) if kind == "strings"
              else objects(p, fixed.BULLET_FIELDS) if kind == "bullets"
              else objects(p, fixed.EVIDENCE_FIELDS, True))
        parts.append(f"WHEN NOT {ok} THEN {_lit('invalid field: ' + name)}")
    return "CASE " + " ".join(parts) + " END"


def _answers_cte():
    return f"""ans AS (SELECT *, {_valid_sql('output_text')} AS validation_error FROM {O.v('v_llm_responses')}),
ok AS (SELECT * FROM ans WHERE validation_error IS NULL)"""


def _sq_llm_validation():
    return f"WITH {_answers_cte()}\nSELECT application_id, validation_error FROM ans"


def _sq_llm_bullets():
    return f"""WITH {_answers_cte()},
x AS (SELECT application_id, json_extract(output_text, '$.bullet_improvements[*]') AS b FROM ok)
SELECT application_id, CAST(i AS BIGINT) AS bullet_no,
       json_extract_string(b[i], '$.original') AS original,
       json_extract_string(b[i], '$.improved') AS improved,
       json_extract_string(b[i], '$.reason') AS reason
FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM x)"""


def _sq_llm_evidence():
    icon = ("CASE st " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in fixed.STATUS_ICONS.items())
            + f" ELSE {_lit(fixed.STATUS_ICON_OTHER)} END")
    return f"""WITH {_answers_cte()},
x AS (SELECT application_id, json_extract(output_text, '$.evidence_checks[*]') AS e FROM ok),
y AS (SELECT application_id, i, json_extract_string(e[i], '$.requirement') AS requirement,
             json_extract_string(e[i], '$.status') AS st, json_extract_string(e[i], '$.evidence') AS evidence,
             json_extract_string(e[i], '$.recommendation') AS recommendation
      FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM x))
SELECT application_id, CAST(i AS BIGINT) AS check_no, requirement, st AS status, evidence, recommendation,
       {icon} AS icon, upper(left(st, 1)) || lower(substr(st, 2)) AS status_label
FROM y"""


def _sq_llm_display():
    def lst(k):
        return (f"coalesce(nullif(array_to_string(json_extract_string(output_text, '$.{k}[*]'), '|'), ''), "
                f"{_lit(fixed.EMPTY_LIST_TEXT[k])})")
    keys = ["required_skills", "preferred_skills", "matched_strengths", "missing_requirements",
            "recommended_keywords", "interview_focus"]
    cols = ", ".join(f"{lst(k)} AS {k}" for k in keys)
    return f"""WITH {_answers_cte()}
SELECT application_id, json_extract_string(output_text, '$.target_role') AS target_role, {cols},
       CAST(json_array_length(output_text, '$.warnings') AS BIGINT) AS n_warnings
FROM ok"""


def _errors_cte():
    rate = " OR ".join([f"contains(err, {_lit(fixed.RATE_LIMIT_CODE)})"] +
                       [f"contains(lower(err), {_lit(m)})" for m in fixed.RATE_LIMIT_MARKERS])
    cls = (f"CASE WHEN err IS NULL THEN NULL WHEN {rate} THEN 'rate_limit' "
           f"WHEN contains(err, {_lit(fixed.KEY_MARKER)}) THEN 'missing_key' ELSE 'other' END")
    return f"""{_answers_cte()},
errs AS (SELECT application_id, error_class,
       CASE error_class WHEN 'rate_limit' THEN {_lit(fixed.MSG_RATE_LIMIT)}
                        WHEN 'missing_key' THEN {_lit(fixed.MSG_NO_KEY)}
                        WHEN 'other' THEN {_lit(fixed.ERR_LLM_PREFIX)} || err END AS message
FROM (SELECT application_id, err, {cls} AS error_class
      FROM (SELECT application_id, coalesce(error, validation_error) AS err FROM ans)))"""


def _sq_llm_errors():
    return f"WITH {_errors_cte()}\nSELECT application_id, error_class, message FROM errs"


def _sq_redaction():
    cols = ", ".join(f"CAST(c_{k} AS BIGINT) AS {k}" for k in fixed.REDACTION_KEYS)
    return f"""WITH {O.redaction_ctes(O.v('v_resumes'))}
SELECT resume_id, sha256(text) AS text_sha, {cols}, CAST(total AS BIGINT) AS total_redactions,
       name IS NOT NULL AS candidate_name_detected
FROM red"""


def _requests_ctes():
    head, mid, tail = map(_lit, (fixed.PROMPT_HEAD, fixed.PROMPT_MIDDLE, fixed.PROMPT_TAIL))
    return f"""{O.redaction_ctes(O.v('v_resumes'))},
req AS (SELECT a.application_id, a.resume_id, a.job_id, red.total,
               {head} || substr(red.text, 1, {fixed.RESUME_PROMPT_CHARS}) || {mid} || substr(j.text, 1, {fixed.JOB_PROMPT_CHARS}) || {tail} AS prompt
        FROM {O.v('v_applications')} a JOIN red ON red.resume_id = a.resume_id JOIN {O.v('v_jobs')} j ON j.job_id = a.job_id
        WHERE a.consent)"""


def _sq_llm_requests():
    return f"""WITH {_requests_ctes()}
SELECT application_id, resume_id, job_id, {_lit(fixed.MODEL_NAME)} AS model, sha256(prompt) AS prompt_sha,
       CAST(length(prompt) AS BIGINT) AS prompt_chars, CAST(total AS BIGINT) AS total_redactions
FROM req"""


def _sq_llm_result():
    return f"""WITH {_requests_ctes()},
{_errors_cte()}
SELECT req.application_id, CASE WHEN error_class IS NULL THEN {_lit(fixed.MODEL_NAME)} END AS model,
       CASE WHEN error_class IS NULL THEN json_extract_string(output_text, '$.target_role') END AS target_role,
       CASE WHEN error_class IS NULL THEN CAST(total AS BIGINT) END AS total_redactions, error_class, message
FROM req JOIN ans ON ans.application_id = req.application_id JOIN errs ON errs.application_id = req.application_id"""


ORACLE: dict[str, Callable[[], str]] = {
    "extract_stats": _sq_extract_stats,
    "text_predicates": _sq_text_predicates,
    "resume_skills": lambda: _sq_skills("v_resumes", "resume_id"),
    "job_skills": lambda: _sq_skills("v_jobs", "job_id"),
    "catalog_skills": _sq_catalog_skills,
    "term_frequency": _sq_term_frequency,
    "similarity": _sq_similarity,
    "best_jobs": _sq_best_jobs,
    "match": _sq_match,
    "sections": _sq_sections,
    "ats_scorecard": _sq_scorecard,
    "ats_checks": _sq_checks,
    "ats_display": _sq_display,
    "candidate_name": _sq_candidate_name,
    "header_redaction": _sq_header_redaction,
    "file_gates": _sq_file_gates,
    "page_assembly": _sq_page_assembly,
    "part_assembly": _sq_part_assembly,
    "input_gates": _sq_input_gates,
    "resume_gates": _sq_resume_gates,
    "redaction": _sq_redaction,
    "llm_requests": _sq_llm_requests,
    "llm_result": _sq_llm_result,
    "bundle": _sq_bundle,
    "latest_bundle": _sq_latest_bundle,
    "session_state": _sq_session_state,
    "json_export": _sq_json_export,
    "file_inventory": _sq_file_inventory,
    "llm_validation": _sq_llm_validation,
    "llm_bullets": _sq_llm_bullets,
    "llm_evidence": _sq_llm_evidence,
    "llm_display": _sq_llm_display,
    "llm_errors": _sq_llm_errors,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}
