"""Connected components over alias keys, by iterated least labels."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the least id reachable. Labels jump along their own labels; lineage is cut by checkpoint()."""
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp())
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct().checkpoint()
    label = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("root"))
    while True:
        near = both.join(label, both["y"] == label["id"]).groupBy("x").agg(F.min("root").alias("m")).withColumnRenamed("x", "id")
        jump = label.select(F.col("id").alias("j"), F.col("root").alias("jr"))
        new = label.join(near, "id").join(jump, F.col("root") == F.col("j"), "left").select("id", F.col("root").alias("old"), F.least("root", "m", "jr").alias("root")).checkpoint()
        if new.where("old <> root").limit(1).count() == 0:
            return new.select("id", "root")
        label = new.select("id", "root")
