"""The corpus pipeline: a table of documents goes through five operators, one after another.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame, which is written as Parquet and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from migraspark.llm import stages
from migraspark.llm.common import kept_table, table

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("sharding", stages.sharding),
]

# A trained model and hashed candidate search are beyond SQL; the tests hold the result against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` after all stages: their columns, with slot and shard."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
