"""The corpus pipeline: documents in, tokenised training mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import stages
from tallywright.llm.common import read, stored

STAGES = [
    ("quality rules", stages.quality_rules),
    ("language id", stages.language_id),
    ("near duplicates", stages.near_duplicates),
    ("source mix", stages.source_mix),
    ("byte-level bpe", stages.byte_bpe),
]

# Learned models and iterative links have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
