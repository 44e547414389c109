"""Corpus pipeline over ``documents``: toxic documents go, one document of each
near-duplicate group stays, passages seen before are cut, sources are mixed to
target weights, and the texts are encoded.

Each stage's result is written as Parquet and read again as the next stage's
input, so a lost executor never sends the work back to the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm.stages import STAGES
from pricelens.session import scratch_path

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, the last one's rows as the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
