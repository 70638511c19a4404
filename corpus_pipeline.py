"""The corpus pipeline: documents in, token ids out, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shootlake.llm import stages
from shootlake.llm.shared import settle, table

STAGES = [
    ("quality_rules", stages.keep_good),
    ("near_duplicates", stages.keep_one_of_each),
    ("decontamination", stages.drop_leaks),
    ("secrets", stages.mask_secrets),
    ("sentencepiece", stages.encode_pieces),
]

#: SQL cannot express SetSketch bands, banded alignment or piece merging; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
