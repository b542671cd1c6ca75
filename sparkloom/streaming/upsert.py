"""Latest row per key over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*names), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, "r.*")


def run(spark: SparkSession, source: str, schema: T.StructType, target: str, keys: list[str], order: list[str], checkpoint: str) -> None:
    """Take in the new JSON files of source and keep target, a table by version, at the latest row per key.

    Each batch writes the next version from the last, so a repeated batch writes the same again.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        old = f"{target}/version={epoch - 1}"
        rows = batch if epoch == 0 else batch.unionByName(spark.read.schema(schema).parquet(old))
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{target}/version={epoch}")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
