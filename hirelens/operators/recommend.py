"""Table-side halves of the optional language-model step.

* requests: consent filter -> redaction -> prompt rows for an external caller
* responses: emptiness, JSON and schema validation of the returned answers,
  exploded bullet improvements and evidence checks, error classes.

The model call itself is outside Spark (an external service). Validation
works on ``VARIANT`` values: ``from_json`` alone would turn numbers into
strings and missing fields into nulls, which the answer schema rejects.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col
from ..session import is_small, keep
from .redact import redact


def prompt(anonymized_resume: Column | str, job_text: Column | str) -> Column:
    """Fixed instructions around the first 15,000 / 12,000 characters."""
    return F.concat(F.lit(fixed.PROMPT_HEAD),
                    F.substring(col(anonymized_resume), 1, fixed.RESUME_PROMPT_CHARS),
                    F.lit(fixed.PROMPT_MIDDLE),
                    F.substring(col(job_text), 1, fixed.JOB_PROMPT_CHARS),
                    F.lit(fixed.PROMPT_TAIL))


def resume_prompts(resumes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The prompt's part of every document, stored once: ``(resume_id, redacted_text, privacy)``, the text
    redacted and cut to the prompt's limit. ``wanted(resume_id)``, if small by count, keeps out the others
    (a larger list would cost an exchange of the texts, so then all are redacted where they are read)."""
    used = resumes.select("resume_id", F.col("text").alias("resume_text"))
    if wanted is not None and is_small(wanted):
        used = used.join(F.broadcast(wanted), "resume_id", "left_semi")
    privacy = F.struct("total_redactions", "redactions", "candidate_name_detected")
    return keep(redact(used, "resume_text").select(
        "resume_id", F.substring("redacted_text", 1, fixed.RESUME_PROMPT_CHARS).alias("redacted_text"),
        privacy.alias("privacy")), "resume-prompts")


def job_prompts(jobs: DataFrame) -> DataFrame:
    """The same of every job: ``(job_id, job_text)``, cut to the prompt's limit."""
    return keep(jobs.select("job_id", F.substring("text", 1, fixed.JOB_PROMPT_CHARS).alias("job_text")), "job-prompts")


def request_options() -> Column:
    """What every call is sent with, beside its prompt."""
    return F.lit(json.dumps({
        "generation_config": {"thinking_level": "low"},
        "response_format": {"type": "text", "mime_type": "application/json", "schema": answer_json_schema()},
        "store": False, "timeout_ms": fixed.REQUEST_TIMEOUT_MS}))


def request_rows(pairs: DataFrame, documents: DataFrame, jobs: DataFrame, consent_col: str = "consent") -> DataFrame:
    """Requests by reference: a narrow row per consented application whose documents exist, with the
    model and the privacy report; the prompt is named by ``resume_id`` and ``job_id``
    (:func:`resume_prompts`, :func:`job_prompts`) and put together by :func:`with_prompts` where it is sent."""
    ids = jobs.select("job_id")
    ok = pairs.filter(F.col(consent_col)).join(F.broadcast(ids) if is_small(ids) else ids, "job_id", "left_semi")
    cols = [c for c in pairs.columns if c != consent_col]
    return ok.join(documents.select("resume_id", "privacy"), "resume_id").select(
        *cols, F.lit(fixed.MODEL_NAME).alias("model"), "privacy")


def with_prompts(requests: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """The requests with ``prompt`` and ``options``. ``requests`` are narrow rows with ``resume_id`` and
    ``job_id``. A document's text is exchanged once, by ``resume_id``; the jobs' texts are broadcast if
    small by their characters. If not, they meet the narrow requests first."""
    texts = documents.select("resume_id", *[c for c in documents.columns if c != "resume_id" and c not in requests.columns])
    if is_small(jobs, F.length("job_text"), limit=32_000_000):
        met = requests.join(texts, "resume_id").join(F.broadcast(jobs), "job_id")
    else:
        met = requests.join(jobs, "job_id").join(texts, "resume_id")
    cols = [c for c in requests.columns if c not in ("model", "privacy")]
    return met.select(*cols, F.lit(fixed.MODEL_NAME).alias("model"), prompt("redacted_text", "job_text").alias("prompt"),
                      request_options().alias("options"), "privacy")


def build_requests(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame,
                   consent_col: str = "consent") -> DataFrame:
    """Rows for consented applications only; the raw résumé text never
    reaches the output (only the redacted one enters the prompt)."""
    wanted = pairs.filter(F.col(consent_col)).select("resume_id").distinct()
    documents, texts = resume_prompts(resumes, wanted), job_prompts(jobs)
    return with_prompts(pairs.filter(F.col(consent_col)).drop(consent_col), documents, texts)


def answer_json_schema() -> dict:
    """JSON schema of an answer, from the field list (types, required names, the status values)."""
    string = {"type": "string"}

    def record(fields: list[str]) -> dict:
        own = {f: {"type": "string", "enum": fixed.EVIDENCE_STATUSES} if f == "status" else string for f in fields}
        return {"type": "object", "properties": own, "required": fields}

    kinds = {"string": string, "strings": {"type": "array", "items": string},
             "bullets": {"type": "array", "items": record(fixed.BULLET_FIELDS)},
             "evidence": {"type": "array", "items": record(fixed.EVIDENCE_FIELDS)}}
    return {"type": "object", "properties": {n: kinds[k] for n, k in fixed.ANSWER_FIELDS},
            "required": [n for n, _ in fixed.ANSWER_FIELDS]}


# ---------------------------------------------------------------------------
# Response validation
# ---------------------------------------------------------------------------
def answer_fields(parsed: Column) -> Column:
    """The answer's fields as a struct of variants, null unless it is an object: one cast
    instead of a walk through the object for every field."""
    return F.try_variant_get(parsed, "$", "struct<" + ", ".join(f"{n}: variant" for n, _ in fixed.ANSWER_FIELDS) + ">")


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == F.lit("STRING"), F.lit(False))


def _is_strings(v: Column) -> Column:
    """An array of strings; the empty one and one of nulls have the same type name."""
    plain = F.coalesce(F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    return plain & ~F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.is_variant_null(e)), F.lit(False))


def _is_objects(v: Column, fields: list[str], status: bool = False) -> Column:
    """An array of objects that have the fields as strings."""
    items = F.try_variant_get(v, "$", "array<struct<" + ", ".join(f"{n}: variant" for n in fields) + ">>")

    def ok(e: Column) -> Column:
        good = e.isNotNull()
        for f in fields:
            good = good & _is_string(e[f])
        if status:
            good = good & F.coalesce(F.try_variant_get(e["status"], "$", "string").isin(*fixed.EVIDENCE_STATUSES), F.lit(False))
        return good

    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY<") & F.forall(items, ok), F.lit(False))


def field_ok(v: Column, kind: str) -> Column:
    if kind == "string":
        return _is_string(v)
    if kind == "strings":
        return _is_strings(v)
    if kind == "bullets":
        return _is_objects(v, fixed.BULLET_FIELDS)
    return _is_objects(v, fixed.EVIDENCE_FIELDS, status=True)


def validation_error(output_text: Column | str, parsed: Column | None = None, fields: Column | None = None) -> Column:
    """Null for a valid answer, else why: empty, not JSON, not an object, or
    the first field (schema order) that is missing or mistyped. Extra keys
    are ignored; list lengths are not limited. ``parsed`` and ``fields``: the variant and its
    :func:`answer_fields`, where columns already hold them."""
    t = col(output_text)
    v = F.try_parse_json(t) if parsed is None else parsed
    own = answer_fields(v) if fields is None else fields
    err = (F.when(t.isNull() | (t == F.lit("")), F.lit(fixed.ERR_EMPTY_ANSWER))
            .when(v.isNull(), F.lit("invalid JSON"))
            .when(own.isNull(), F.lit("answer is not a JSON object")))
    for name, kind in fixed.ANSWER_FIELDS:
        err = err.when(~field_ok(own[name], kind), F.lit(f"invalid field: {name}"))
    return err


ANSWER_SCHEMA = (
    "target_role string, overall_assessment string, required_skills array<string>, "
    "preferred_skills array<string>, matched_strengths array<string>, "
    "missing_requirements array<string>, recommended_keywords array<string>, "
    "tailored_summary string, "
    "bullet_improvements array<struct<original:string, improved:string, reason:string>>, "
    "evidence_checks array<struct<requirement:string, status:string, evidence:string, "
    "recommendation:string>>, interview_focus array<string>, warnings array<string>"
)


def parse_responses(df: DataFrame, text_col: str = "output_text", analysis: bool = True) -> DataFrame:
    """Add ``validation_error`` and ``analysis`` (typed struct, null unless valid; not with ``analysis=False``).

    Both leave through a one-element ``explode``: a filter on them would else be pushed below and
    parse and check every answer again for each field it names."""
    parsed = df.withColumn("__answer", F.try_parse_json(col(text_col)))
    parsed = parsed.withColumn("__fields", answer_fields(F.col("__answer")))
    parsed = parsed.withColumn("__error", validation_error(text_col, F.col("__answer"), F.col("__fields")))
    own = [F.col("__error").alias("validation_error")]
    if analysis:
        own.append(F.when(F.col("__error").isNull(), F.from_json(col(text_col), ANSWER_SCHEMA)).alias("analysis"))
    return parsed.select(*df.columns, F.explode(F.array(F.struct(*own))).alias("__own")).select(*df.columns, "__own.*")


def call_error(error: Column | str, validation: Column | str) -> Column:
    """What went wrong with a call: its own error, or else why its answer is invalid."""
    return F.coalesce(col(error), col(validation))


def results(answers: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, result, error_class, message)``: every request with its answer; a valid answer is
    wrapped with the model name and the request's privacy report, a failed one is classified."""
    got = answers.select(*keys, "analysis", call_error("error", "validation_error").alias("__error"))
    met = requests.select(*keys, "privacy").join(got, keys)
    ok = F.col("__error").isNull()
    return met.select(*keys, F.when(ok, result_wrapper(F.col("analysis"), F.col("privacy"))).alias("result"),
                      error_class("__error").alias("error_class"), error_message("__error").alias("message"))


def result_wrapper(analysis: Column, privacy: Column) -> Column:
    """``model, analysis, privacy`` as returned to the caller."""
    return F.struct(F.lit(fixed.MODEL_NAME).alias("model"), analysis.alias("analysis"),
                    privacy.alias("privacy"))


def bullet_rows(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per bullet improvement, numbered from 1, display defaults applied."""
    d = fixed.BULLET_DEFAULTS
    x = df.select(*id_cols, F.posexplode("analysis.bullet_improvements").alias("pos", "b"))
    return x.select(*id_cols, (F.col("pos") + 1).alias("bullet_no"),
                    *[F.coalesce(F.col(f"b.{f}"), F.lit(d[f])).alias(f) for f in fixed.BULLET_FIELDS])


def status_icon(status: Column) -> Column:
    m = F.create_map(*[x for k, v in fixed.STATUS_ICONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, status), F.lit(fixed.STATUS_ICON_OTHER))


def evidence_rows(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per evidence check with ordinal, icon and title-cased status."""
    d = fixed.EVIDENCE_DEFAULTS
    x = df.select(*id_cols, F.posexplode("analysis.evidence_checks").alias("pos", "e"))
    vals = {f: F.coalesce(F.col(f"e.{f}"), F.lit(d[f])) for f in fixed.EVIDENCE_FIELDS}
    return x.select(*id_cols, (F.col("pos") + 1).alias("check_no"),
                    *[v.alias(f) for f, v in vals.items()],
                    status_icon(vals["status"]).alias("icon"),
                    F.initcap(vals["status"]).alias("status_label"))


def error_class(error: Column | str) -> Column:
    """rate_limit / missing_key / other for a failed call (null when no error)."""
    e = col(error)
    low = F.lower(e)
    rate = e.contains(fixed.RATE_LIMIT_CODE)
    for marker in fixed.RATE_LIMIT_MARKERS:
        rate = rate | low.contains(marker)
    return (F.when(e.isNull(), F.lit(None).cast("string"))
             .when(rate, F.lit("rate_limit"))
             .when(e.contains(fixed.KEY_MARKER), F.lit("missing_key"))
             .otherwise(F.lit("other")))


def error_message(error: Column | str) -> Column:
    e = col(error)
    cls = error_class(e)
    return (F.when(cls == "rate_limit", F.lit(fixed.MSG_RATE_LIMIT))
             .when(cls == "missing_key", F.lit(fixed.MSG_NO_KEY))
             .when(cls == "other", F.concat(F.lit(fixed.ERR_LLM_PREFIX), e)))


def list_or_default(items: Column, key: str) -> Column:
    """The shown list, or the one-element fallback text when it is empty."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(
        F.array(F.lit(fixed.EMPTY_LIST_TEXT[key])))
