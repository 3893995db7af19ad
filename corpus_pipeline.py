"""The corpus pipeline: documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept:

- language_id drops documents whose language can't be told (no letters, or no word or n-gram that the model knows);
- near_duplicates keeps one document of each component of documents whose five-word shingles have a similarity of 0.8
  or more, that with the smallest doc_id;
- decontamination drops documents that benchmark items cover to 5 % or more and cuts hit spans from the others;
- secrets replaces every secret span by a mark;
- packing returns the pieces of the packed sequences.

All but the last return the columns of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, neardup, packing, secrets
from tidemark.llm.common import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", pack)]

#: Automata, components and dynamic programs aren't expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
