"""Registered queries of the training-data operators: one ``opN_<name>`` per operator.

Each applies its operator with production parameters to its whole table and
derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import align, chat, counts, decontaminate, lines, mixing, pieces, pii, quality, runs, simhash, sketch, substring

# The tokenizer files are found by the public package's path(); they are parameters of the operators.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), tokenizer(PIECES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), (quality.fold() == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), _split_pattern())


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.verdicts(_table(spark, sf_dir, "documents")).drop("source")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        "SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.windows(talks, tokenizer(BYTE_BPE), _split_pattern()))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_and_next(_table(spark, sf_dir, "documents"))


def _periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's planted period: (first word, period) for a tenth of the ids. No id: no tail."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(_table(spark, sf_dir, "documents"), rewrite=_periodic_tail)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), _split_pattern(), tokenizer(PIECES))


QUERIES = {f.__name__: f for f in (
    op1_context_mixing, op2_pii, op3_sentencepiece, op4_quality, op5_token_counts, op6_line_rules, op7_decontamination,
    op8_chat, op9_substring_dedup, op10_simhash, op11_sketch, op12_runs,
    op13_alignment)}

# The digest is of the words that no repeated 35-word window covers.
ORACLE_SQL = {
    "op6_line_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
         '[^\\x20\\x09-\\x0D]+') AS lw
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
own AS (SELECT doc_id, source, line, len(lw) AS n, array_to_string(lw, ' ') AS norm FROM ln WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM own GROUP BY doc_id),
common AS (SELECT source, norm FROM own GROUP BY source, norm HAVING count(DISTINCT doc_id) > {lines.MIN_DOCS}),
gone AS (SELECT doc_id, sum(n) AS n FROM own JOIN common c ON c.norm = own.norm AND c.source IS NOT DISTINCT FROM own.source GROUP BY doc_id),
x AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words_removed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - n_line_words_removed) >= n_words AS kept
FROM x
""",
    "op9_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)),
word AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word LEFT JOIN cut ON cut.doc_id = word.doc_id AND cut.p = word.p WHERE cut.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
}
