"""A training-data pipeline over ``documents``: each stage works on what the one before kept.

All stages but the last return the columns of ``documents``; the last returns the pieces of packed
sequences. SQL cannot express the classifier or the tokenizer, so the pipeline is tested against
versions of its stages in plain Python. What the stages do with nulls and other corners is in ``lodestar.llm.stages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import stages
from lodestar.sources.shared import settle

STAGES = [
    ("quality_classifier", stages.good_quality),
    ("quality_rules", stages.by_rules),
    ("simhash_near_dedup", stages.without_copies),
    ("benchmark_decontamination", stages.without_benchmark),
    ("packing", stages.packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each one's rows are written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
