"""Filter, deduplicate and pack the documents, stage by stage.

Each stage takes what the one before it kept. A stage's decisions drop rows or, in the suffix-array stage, the
repeated bytes of a text, in passages of substrings.PASSAGE bytes or more, about 50 words; n_chars is then the new length, and a document that loses all its bytes
goes, while one without text on input passes as it is. The last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact, near, packing, quality, store, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bare = F.coalesce("text", F.lit("")) == ""
    left = substrings.remove(docs.where(~bare), length=substrings.PASSAGE)
    left = left.where(F.col("text") != "").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
    return left.unionByName(docs.where(bare))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit),
]

#: SQL cannot express the learned rules or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
