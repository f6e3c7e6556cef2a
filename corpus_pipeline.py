"""Corpus pipeline: the stages that turn ``documents`` into token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hirelens.llm import common, decontaminate, pieces, pii, quality, simhash
from hirelens.llm.queries import PIECES, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (it learns from ``labels``)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one whose id names it."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text's best segmentation, with the scores of its n best."""
    return pieces.encode(docs, tokenizer(PIECES))


STAGES = [
    ("quality", good_quality),
    ("simhash", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_personal_data),
    ("sentencepiece", encoded),
]

# Boosted trees, XXH64 with a seed and lattice search have no SQL form; tests/llm has a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{at}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{i}-{name}")
    return docs
