"""Language ID, near-duplicate removal, repeated passages and packing over `documents`, one table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.sources.scratch import written

STAGES = [
    ("language id", stages.keep_named_language),
    ("minhash near-dedup", stages.keep_one_of_each),
    ("substring dedup", stages.cut_repeats),
    ("packing", stages.pack),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
