"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shards(df: DataFrame, path: str, rows: int = 2500) -> None:
    """Parquet files of at most so many rows; an existing folder is refused."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(path)


def by_split(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("errorifexists").partitionBy(*(keys or ("split",))).json(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replaced(df: DataFrame, path: str, form: str = "json") -> None:
    """Write df beside path and put it in path's place by a rename, so that readers never see a part of it."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    staged, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{k}-{uuid.uuid4().hex[:8]}") for k in ("new", "old"))
    df.write.format(form).save(staged.toString())
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staged, target):
        raise OSError(f"cannot put {path} in place")
    if there:
        fs.delete(old, True)


def without(df: DataFrame, path: str, *payload: str) -> None:
    """JSON lines of df without its payload columns."""
    df.drop(*payload).write.mode("errorifexists").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unchanged_by(spark: SparkSession, path: str, work) -> None:
    """Run work() and fail if it changes the files in a folder. Their checksums, a row per file, meet in Spark."""
    before = [tuple(r) for r in checksums(spark, path).collect()]
    work()
    if sorted(before) != sorted(tuple(r) for r in checksums(spark, path).collect()):
        raise ValueError(f"{path} changed")


def catalog(tables: dict[str, DataFrame], folder: str, views: dict[str, str]) -> None:
    """Write tables as Parquet and make them and the views (name: SQL) known to the session."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        df.sparkSession.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)
    spark = next(iter(tables.values())).sparkSession
    for name, sql in views.items():
        spark.sql(sql).createOrReplaceTempView(name)


def merged_logs(spark: SparkSession, paths: list[str], schema: str, keys: list[str]) -> DataFrame:
    """The ranks' logs as one; a key that two rows have fails the read."""
    from sparkloom.sources.runs import unique

    return unique(spark.read.schema(schema).json(paths), keys)
