"""Corpus pipeline over documents: each stage is one operator and reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideflow.llm import stages
from strideflow.llm.common import store

#: Name and function of every stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("toxicity", stages.toxicity),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("source_mix", stages.source_mix),
    ("packing", stages.packing),
]

#: Model training and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again.

    Empty tables, null columns and repeated rows run through as the stages say (see ``strideflow.llm.stages``).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
