"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing of sources, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.language import in_a_language
from kindred.llm.mixing import mixed_documents
from kindred.llm.near_text import one_of_each
from kindred.llm.sharding import sharded
from kindred.llm.store import written
from kindred.llm.tiling import uncontaminated

#: Each stage takes (spark, docs, sf_dir); its result, written as Parquet and read again, is the next one's docs.
STAGES = [
    ("language_id", lambda spark, docs, sf_dir: in_a_language(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: one_of_each(docs, k=5, percent=80)),
    ("decontamination", lambda spark, docs, sf_dir: uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))),
    ("mixing", lambda spark, docs, sf_dir: mixed_documents(docs)),
    ("sharding", lambda spark, docs, sf_dir: sharded(docs)),
]

#: A conditional random field and differencing on the driver can't be told in SQL; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
