"""Readers of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, mode: str = "strict") -> DataFrame:
    """JSON lines with a declared schema.

    strict: a bad line fails the read. tolerant: bad lines are left out. audit: a bad line is a row whose
    _corrupt_record holds it.
    """
    if mode == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows if mode == "audit" else rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (name: type); those df lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def turn_column(df: DataFrame) -> str:
    """The first of the names under which turns are stored."""
    return next(c for c in ("messages", "trajectory", "conversation") if c in df.columns)
