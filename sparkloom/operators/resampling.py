"""Bootstrap intervals of group means, by Poisson weights from hashes.

A draw weighs each row by a Poisson(1) count instead of picking row numbers, so draws are sums that
combine before the shuffle and no group's rows meet in one task. What is shuffled is one row per
group, draw and task, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_HASH = 8  # a SHA-256 holds eight numbers of 32 bits
CUTS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]


def poisson(number: Column) -> Column:
    """The Poisson(1) count of a whole number below 2**32."""
    return sum(((number >= F.lit(c)).cast("int") for c in CUTS[1:]), (number >= F.lit(CUTS[0])).cast("int"))


def bootstrap(rows: DataFrame, group: str, key: str, value: str, draws: int = 2000) -> DataFrame:
    """(group, low, high): the 95 % interval of each group's mean of value.

    key tells a group's rows apart. Rows without a value are left out. A draw that weighs every row 0 is left out; of m draws,
    the ends are those of rank m div 40 from below and above. A group without rows is absent.
    """
    if draws % PER_HASH:
        raise ValueError(f"draws must be a multiple of {PER_HASH}")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(draws // PER_HASH - 1))).alias("block")
    r = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
    r = r.select("g", "k", "v", blocks).withColumn("h", F.sha2(F.concat_ws(":", F.col("g").cast("string"), "k", F.col("block").cast("string")), 256))
    weight = [poisson(F.conv(F.substring("h", 8 * j + 1, 8), 16, 10).cast("long")) for j in range(PER_HASH)]
    sums = [f for j, w in enumerate(weight) for f in (F.sum(w).alias(f"n{j}"), F.sum(w * F.col("v")).alias(f"s{j}"))]
    drawn = r.groupBy("g", "block").agg(*sums)
    means = drawn.select("g", F.explode(F.array(*[F.when(F.col(f"n{j}") > 0, F.col(f"s{j}") / F.col(f"n{j}")) for j in range(PER_HASH)])).alias("mean")).where("mean is not null")
    w = W.partitionBy("g")
    ranked = means.withColumn("i", F.row_number().over(w.orderBy("mean")) - 1).withColumn("m", F.count("*").over(w))
    at = lambda e: F.max(F.when(F.col("i") == F.expr(e), F.col("mean")))
    return ranked.groupBy(F.col("g").alias(group)).agg(at("m div 40").alias("low"), at("m - 1 - m div 40").alias("high"))
