"""Input tables and the derived views the queries run on.

The driver's tables hold no résumé-like content, so the fixture views
plant it (deterministically, per row id) into the real ``documents`` /
``benchmark`` text -- every row is kept, nothing is sampled. Each view's
SQL text is shared verbatim by Spark (``spark.sql`` with DataFrame
arguments) and by the DuckDB oracle, so both engines see identical rows.
``{name}`` placeholders are table references; literal braces are doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD = "spark.hirelens.spread"
SPREAD_ROWS = 2000          # smaller shares are not worth a task


def spread(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Deal the rows of a table to more tasks, if its files keep them in few.

    A row group is read by one task, whatever its size. ``stored``, the table as it is read,
    tells from the files' footers how many rows each task gets; if the largest share is over
    twice an even one, ``df`` is exchanged by row number (any key may be null or frequent), else
    nothing is shuffled. ``spark.hirelens.spread`` fixes a number of partitions."""
    spark = df.sparkSession
    n = spark.conf.get(SPREAD, None)
    if not n:
        shares = stored.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
        cores = spark.sparkContext.defaultParallelism
        if (shares.most or 0) <= max(SPREAD_ROWS, 2 * shares.rows / cores if shares.rows else 0):
            return df
        n = max(2, min(4 * cores, shares.rows // SPREAD_ROWS * 4))
    return df.withColumn("__row", F.monotonically_increasing_id()).repartition(int(n), "__row").drop("__row")


# Résumés: planted contact details, headings and skills in front of each document.
V_RESUMES = """
SELECT doc_id AS resume_id,
       CASE doc_id % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.txt' ELSE '.pdf' END AS extension,
       CASE WHEN doc_id % 23 = 9 THEN concat(' ', chr(10), chr(9)) ELSE concat_ws(chr(10),
         CASE doc_id % 4 WHEN 0 THEN 'Priya Nair' WHEN 1 THEN 'JOHN B SMITH'
                         WHEN 2 THEN 'Curriculum Vitae' ELSE 'Senior Data Engineer' END,
         CASE WHEN doc_id % 2 = 0 THEN concat('user', CAST(doc_id AS VARCHAR(20)), '@example.com') END,
         CASE WHEN doc_id % 3 = 0 THEN '+91 98765 43210' END,
         CASE WHEN doc_id % 5 = 0 THEN 'https://github.com/u1' END,
         CASE WHEN doc_id % 7 = 0 THEN '12 Lake Road, Pune 411001' END,
         CASE WHEN doc_id % 11 = 0 THEN 'DOB: 01-02-1990' END,
         CASE WHEN doc_id % 13 = 0 THEN 'ID 1234 5678 9012' END,
         CASE WHEN doc_id % 17 = 0 THEN 'Tax ABCDE1234F' END,
         CASE WHEN doc_id % 3 <> 1 THEN 'Professional Summary' END,
         CASE WHEN doc_id % 4 <> 3 THEN 'SKILLS:' END,
         CASE doc_id % 6 WHEN 0 THEN 'Python, SQL, Docker; teamwork'
                         WHEN 1 THEN 'Java | Spring Boot | REST API | leadership'
                         WHEN 2 THEN 'C++ and C#, Linux, problem-solving'
                         WHEN 3 THEN 'JavaScript, react.js, node.js, html5, css3'
                         WHEN 4 THEN 'machine learning, pandas, sklearn, communication'
                         WHEN 5 THEN 'ＰＹＴＨＯＮ, ＳＱＬ' END,
         CASE WHEN doc_id % 5 <> 2 THEN 'Work Experience' END,
         CASE WHEN doc_id % 2 = 0 THEN 'Jan 2019 - March 2021' WHEN doc_id % 3 = 0 THEN '2020' END,
         CASE WHEN doc_id % 7 <> 1 THEN 'Education' END,
         CASE WHEN doc_id % 8 = 0 THEN 'Certifications' WHEN doc_id % 8 = 1 THEN 'Key Projects' END,
         text) END AS text
FROM {documents}
"""

# Jobs: planted requirement lines in front of each benchmark text.
V_JOBS = """
SELECT item_id AS job_id,
       CASE WHEN item_id % 13 = 6 THEN concat(' ', chr(10)) ELSE concat_ws(chr(10),
         CASE item_id % 5 WHEN 0 THEN 'We need Python, SQL, AWS and Docker.'
                          WHEN 1 THEN 'Java developer: Spring Boot, REST API, Git, Kubernetes.'
                          WHEN 2 THEN 'Embedded engineer: C, C++, Linux.'
                          WHEN 3 THEN 'Front end: JavaScript, TypeScript, React, HTML, CSS.' END,
         CASE item_id % 3 WHEN 0 THEN 'Teamwork and communication required.'
                          WHEN 1 THEN 'Leadership, problem solving.' END,
         text) END AS text
FROM {benchmark}
"""

# Applications (résumé, job, session, time, consent) derived from the event log. A résumé
# meets one or two jobs; a third of the résumés meet job 0; seven ids have no résumé.
V_APPLICATIONS = """
SELECT application_id, session_id, resume_id,
       CASE WHEN resume_id % 3 = 0 THEN 0 ELSE (resume_id + application_id % 2) % jobs END AS job_id,
       ts, consent
FROM (SELECT e.event_id AS application_id, CAST(e.user_id AS STRING) AS session_id,
             e.event_id % ((SELECT count(*) FROM {documents}) + 7) AS resume_id,
             (SELECT count(*) FROM {benchmark}) AS jobs, e.ts AS ts, e.event_type <> 'error' AS consent
      FROM {events} e) x
"""

# Page texts of multi-page documents: one conversation = one document, one
# turn = one page; some pages are blank.
V_PAGES_TEXT = """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_no,
       CASE WHEN (conv_id + turn) % 6 = 5 OR conv_id % 10 = 4 THEN concat(' ', chr(9), ' ') ELSE text END AS text
FROM {conversations}
"""

# Uploaded files: names with assorted extensions, some of them empty.
V_FILES = """
SELECT page_id AS file_id,
       concat('uploads/', CASE page_id % 7 WHEN 4 THEN '' ELSE concat('cv_', CAST(page_id AS STRING)) END,
              CASE page_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx'
                               WHEN 3 THEN '.txt' WHEN 4 THEN '.pdf' WHEN 5 THEN '.tar.docx'
                               ELSE '' END) AS path,
       CASE WHEN page_id % 9 = 0 THEN '' ELSE html END AS body
FROM {pages}
"""

# Answers of the external model, one per application: valid ones and the
# failure shapes the validator must reject (or accept).
_HEAD = (
    "'{{\"target_role\": \"Role ' || CAST(a.job_id AS STRING) || '\", "
    "\"overall_assessment\": \"Fit for session ' || a.session_id || '\", "
    "\"required_skills\": [\"Python\", \"SQL\"], \"preferred_skills\": [], "
    "\"matched_strengths\": [\"s' || CAST(a.resume_id AS STRING) || '\"], "
    "\"missing_requirements\": [\"Docker\"], \"recommended_keywords\": [\"kw\"], "
    "\"tailored_summary\": \"Summary ' || CAST(a.application_id AS STRING) || '\", "
    "\"evidence_checks\": [{{\"requirement\": \"Python\", \"status\": \"matched\", "
    "\"evidence\": \"e1\", \"recommendation\": \"keep\"}}, {{\"requirement\": \"Docker\", "
    "\"status\": \"' || CASE a.application_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' "
    "ELSE 'matched' END || '\", \"evidence\": \"Not found\", \"recommendation\": \"learn\"}}], "
    "\"interview_focus\": [\"design\"], '"
)
_ONE_BULLET = "'\"bullet_improvements\": [{{\"original\": \"o1\", \"improved\": \"i1\", \"reason\": \"r1\"}}]'"
_FOUR_BULLETS = ("'\"bullet_improvements\": [{{\"original\": \"a\", \"improved\": \"b\", \"reason\": \"c\"}}, "
                 "{{\"original\": \"d\", \"improved\": \"e\", \"reason\": \"f\"}}, "
                 "{{\"original\": \"g\", \"improved\": \"h\", \"reason\": \"i\"}}, "
                 "{{\"original\": \"j\", \"improved\": \"k\", \"reason\": \"l\"}}]'")
_VALID = f"{_HEAD} || {_ONE_BULLET} || ', \"warnings\": []}}}}'"
V_LLM_RESPONSES = f"""
SELECT a.application_id, a.resume_id, a.job_id,
       CASE a.application_id % 9
         WHEN 0 THEN ''
         WHEN 1 THEN '{{{{"target_role": "Engineer"'
         WHEN 2 THEN {_VALID}
         WHEN 3 THEN {_HEAD} || {_ONE_BULLET} || '}}}}'
         WHEN 4 THEN replace({_VALID}, '"matched"', '"unknown"')
         WHEN 5 THEN replace({_VALID}, '"Role ', '7, "x": "')
         WHEN 6 THEN {_HEAD} || {_FOUR_BULLETS} || ', "warnings": ["w"], "extra": 1}}}}'
         WHEN 7 THEN {_HEAD} || {_ONE_BULLET} || ', "warnings": [null]}}}}'
         ELSE '[1, 2]'
       END AS output_text,
       CASE WHEN a.consent THEN NULL
            WHEN a.application_id % 4 = 0 THEN '429 Too Many Requests'
            WHEN a.application_id % 4 = 1 THEN 'status RESOURCE_EXHAUSTED for model'
            WHEN a.application_id % 4 = 2 THEN 'GEMINI_API_KEY is not configured.'
            ELSE 'connection reset by peer' END AS error
FROM ({V_APPLICATIONS}) a
"""

# A catalog that grows with the data: two phrases of each benchmark text as the aliases of one skill.
V_CATALOG = """
SELECT 'phrase' AS family, concat('item ', CAST(item_id AS STRING)) AS skill, alias
FROM (SELECT item_id, regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+', 0) AS alias FROM {benchmark}
      UNION ALL SELECT item_id, regexp_extract(text, '[^ ]+ [^ ]+ [^ ]+ [^ ]+$', 0) FROM {benchmark}) x
WHERE alias <> ''
"""

VIEWS = {
    "v_resumes": (V_RESUMES, ["documents"]),
    "v_jobs": (V_JOBS, ["benchmark"]),
    "v_applications": (V_APPLICATIONS, ["events", "documents", "benchmark"]),
    "v_pages_text": (V_PAGES_TEXT, ["conversations"]),
    "v_files": (V_FILES, ["pages"]),
    "v_catalog": (V_CATALOG, ["benchmark"]),
    "v_llm_responses": (V_LLM_RESPONSES, ["events", "documents", "benchmark"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, deps = VIEWS[name]
    return spark.sql(sql, **{d: table(spark, sf_dir, d) for d in deps})


def view_sql(name: str) -> str:
    """The same view as a DuckDB sub-select over the pre-registered tables."""
    sql, deps = VIEWS[name]
    return sql.format(**{d: d for d in deps})


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, "v_resumes"), table(spark, sf_dir, "documents"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_jobs")


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, "v_llm_responses"), table(spark, sf_dir, "events"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_applications")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCX-like parts from conversations: user turns are paragraphs; other
    turns are table rows (one cell per line), headers or footers."""
    c = table(spark, sf_dir, "conversations")
    kind = (F.when(F.col("role") == "user", "paragraph")
             .when(F.col("turn") % 4 == 1, "cell")
             .when(F.col("turn") % 4 == 3, "header")
             .otherwise("footer"))
    # all parts of every tenth document are blank
    c = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("turn"), kind.alias("kind"),
                 F.when(F.col("conv_id") % 10 == 3, F.lit(" \t")).otherwise(F.col("text")).alias("text"))
    cells = (c.filter(F.col("kind") == "cell")
              .select("doc_id", "kind", F.lit(0).alias("section_no"), F.lit(0).alias("table_no"),
                      F.col("turn").alias("row_no"),
                      F.posexplode(F.split("text", "\n")).alias("cell_no", "text"))
              .select("doc_id", "kind", "section_no", "table_no", "row_no",
                      F.col("cell_no").cast("int").alias("cell_no"), F.lit(0).alias("ord"), "text"))
    other = (c.filter(F.col("kind") != "cell")
              .select("doc_id", "kind", (F.col("turn") % 2).alias("section_no"),
                      F.lit(0).alias("table_no"), F.lit(0).alias("row_no"),
                      F.lit(0).alias("cell_no"), F.col("turn").alias("ord"), "text"))
    return cells.unionByName(other)


_PARTS_FROM = """(SELECT conv_id, turn, role, CASE WHEN conv_id % 10 = 3 THEN concat(' ', chr(9)) ELSE text END AS text
      FROM conversations)"""
PARTS_SQL = f"""
SELECT conv_id AS doc_id, 'cell' AS kind, 0 AS section_no, 0 AS table_no, CAST(turn AS INT) AS row_no,
       CAST(i - 1 AS INT) AS cell_no, 0 AS ord, string_split(text, chr(10))[i] AS text
FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {_PARTS_FROM}
      WHERE role <> 'user' AND turn % 4 = 1)
UNION ALL
SELECT conv_id, CASE WHEN role = 'user' THEN 'paragraph' WHEN turn % 4 = 3 THEN 'header' ELSE 'footer' END,
       CAST(turn % 2 AS INT), 0, 0, 0, CAST(turn AS INT), text
FROM {_PARTS_FROM} WHERE role = 'user' OR turn % 4 <> 1
"""
