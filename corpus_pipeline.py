"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents.

Defined results, in every stage: rows are told apart by doc_id and text, so one doc_id may stand for several texts and may be
null; a null or empty text fails the quality rules; very long texts are read whole; of equal texts one row stays, that of the
smallest doc_id; repeated rows count as copies; empty tables pass through; extra columns are carried along to the last stage,
which returns its own, and their names may be any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lipika.llm.common import materialize
from lipika.llm.decontamination import clean_documents
from lipika.llm.mixing import mixed_documents
from lipika.llm.neardup import representatives
from lipika.llm.quality import kept_documents, labels_beside
from lipika.llm.sharding import shard_documents

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, labels_beside(spark, sf_dir))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
