"""Running sums of doubles against a limit, and sums in a stated order.

A sum of doubles depends in its last bits on the order of additions. Where amounts meet a limit exactly in decimals, those bits decide
on which side of it a row falls, so sums that have to agree with those of the SQL's engine (DuckDB 2.0) are added in its order.

For a running sum that engine deals partitions by a hash of their key into groups, lays a group's partitions one behind the other
in the order of their keys, and builds a tree over the group in which 16 neighbours make a node. A sum over rows from a to b adds,
from 0, the rows from a to the next multiple of 16, then nodes of 16 up to one of 256 and so on, then down again to single rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 16
GROUP_ROWS = 122880
NULL_HASH = np.uint64(13787848793156543929)


def _hashes(keys: pd.Series) -> np.ndarray:
    """The engine's 64-bit hashes of whole numbers."""
    x = keys.fillna(0).to_numpy().astype(np.int64).view(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.where(keys.isna(), NULL_HASH, x ^ (x >> np.uint64(32)))


@F.pandas_udf(T.LongType())
def _dealt(keys: pd.Series) -> pd.Series:
    # eight bits below the upper sixteen; fewer groups go by the lower of them
    return pd.Series(((_hashes(keys) >> np.uint64(40)) & np.uint64(255)).astype(np.int64))


def _group(key: Column, rows: Column) -> Column:
    """The group of a key of a table of so many rows: of 16, 64 or 256 groups, as its rows would be more than GROUP_ROWS a group."""
    hash8 = _dealt(key)
    # n groups take the n-th part from above of what lies below the upper sixteen bits
    return F.when(rows < (GROUP_ROWS + 1) * 16, F.shiftright(hash8, 4)).when(rows < (GROUP_ROWS + 1) * 64, F.shiftright(hash8, 2)).otherwise(hash8)


def places(rows: DataFrame, key: str) -> DataFrame:
    """(key, start): where the rows of a key start within their group. Null is a key, before the others."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).withColumn("group", _group(F.col(key), F.col("total")))
    return n.select(key, (F.sum("n").over(W.partitionBy("group").orderBy(F.col(key).asc_nulls_first())) - F.col("n")).alias("start"))


class TreeSum:
    """Sums over rows from start on, as each row is added; it holds two numbers a level."""

    def __init__(self, start: int):
        self.start = self.at = start
        self.sums = [0.0]  # by level: all up to here but for what belongs to unfinished nodes of that level
        self.nodes = [0.0]  # by level: what the unfinished node holds

    def add(self, x: float | None) -> float:
        self.at += 1
        sums, nodes = self.sums, self.nodes
        level, width = 0, 1
        if x is not None:
            sums[0] += x
        node = x or 0.0
        while True:
            level, width = level + 1, width * FANOUT
            if level == len(sums):
                sums.append(0.0)
                nodes.append(0.0)
            nodes[level] += node
            if self.at % width:
                return sums[0]
            # a node that starts before the first row counts by its parts
            node, nodes[level] = nodes[level], 0.0
            if self.at - width < self.start:
                sums[level] = sums[level - 1]
            else:
                sums[level] += node
            sums[:level] = [sums[level]] * level


def within(rows: DataFrame, key: str, order: list[str], value: str, limit: float) -> DataFrame:
    """The rows before which their key has spent less than limit: the running sum of value by order, less the row's own.

    order has to tell a key's rows apart; nulls come last in it. Spark's running sum decides wherever no order of
    additions could decide otherwise; rows up to a key's last one that lies closer to the limit are added as by the engine.
    """
    columns, own = rows.columns, W.partitionBy(key)
    so_far = own.orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumn("_i", F.row_number().over(own.orderBy(*[F.col(c).asc_nulls_last() for c in order])))
    r = r.withColumn("_spent", F.sum(value).over(so_far) - F.col(value)).withColumn("_size", F.sum(F.abs(value)).over(so_far))
    # two orders differ by less than 2 n rounding errors of half an ulp each
    error = (F.col("_i") + 4) * 2.0**-50 * (F.col("_size") + abs(limit))
    r = r.withColumn("_last", F.max(F.when(~(F.abs(F.col("_spent") - limit) > error) | F.isnan("_size"), F.col("_i"))).over(own))
    is_open = F.coalesce(F.col("_i") <= F.col("_last"), F.lit(False))
    settled = r.where(~is_open & (F.col("_spent") < limit)).select(*columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            sums = []
            for i, start, x in zip(b["_i"].to_pylist(), b["_start"].to_pylist(), b[value].to_pylist()):
                if i == 1:
                    tree = TreeSum(start)
                sums.append(tree.add(x))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(sums, pa.float64())], [*columns, "_sum"])

    starts = places(rows, key).select(F.col(key).alias("_key"), F.col("start").alias("_start"))
    few = r.where(is_open).join(starts, F.col(key).eqNullSafe(F.col("_key"))).select(*columns, "_i", "_start")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    summed = few.repartition(key).sortWithinPartitions(key, "_i").mapInArrow(add, f"{fields}, _sum double")
    return settled.unionByName(summed.where(F.col("_sum") - F.col(value) < limit).select(*columns))


def ordered_means(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, mean): means whose sums are added row by row in a stated order, which has to tell a group's rows apart."""
    own = W.partitionBy(*keys).orderBy(*order)
    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    r = rows.select(*keys, F.row_number().over(own).alias("_i"), (F.sum(value).over(so_far) / F.count(value).over(so_far)).alias("_mean"))
    return r.groupBy(*keys).agg(F.max_by("_mean", "_i").alias("mean"))
