"""From raw documents to packed training sequences: five stages, each an operator of ``tidemark.llm`` on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, packing, quality, substring_dedup
from tidemark.llm.common import Scratch

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", jaccard.stage),
    ("substring_dedup", substring_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Trained models, MinHash and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents under ``sf_dir``. Each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
