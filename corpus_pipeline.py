"""The corpus pipeline: stages over documents, each written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import decontaminate, language, minhash, pieces, repeats
from proofmill.llm.common import Scratch

STAGES = [
    ("language_id", language.stage),
    ("near_duplicates", minhash.stage),
    ("suffix_dedup", repeats.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: No stage can be expressed in SQL; tests/llm/test_pipeline.py chains brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, in order; null texts, repeated rows and empty tables pass as each stage says."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), []
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return docs
