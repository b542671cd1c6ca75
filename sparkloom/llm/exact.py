"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; their SHA-256 stands for them. Each
task keeps a Misra-Gries summary of its digests; a digest whose summed counters reach
rows / (COUNTERS + 1) may be frequent, and at most COUNTERS + 1 can. Those are counted
exactly, and the winners, with the row that stays, are broadcast for map-side
removal. The other digests are aggregated by an ordinary shuffle; none of them can have more than
2 * rows / (COUNTERS + 1) rows.

Results: null and empty texts are equal to each other; of equal texts the row with the largest
id stays, a null id least; repeated rows with the same id all count as that row.
An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import store

#: Counters of a summary, which bound what is collected and broadcast.
COUNTERS = 1000


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


class MisraGries:
    """At most k counters; each falls short of its item's count by at most n / (k + 1)."""

    def __init__(self, k: int) -> None:
        self.k, self.of = k, {}

    def add(self, item, n: int = 1) -> None:
        of = self.of
        if item in of or len(of) < self.k:
            of[item] = of.get(item, 0) + n
            return
        least = min(n, min(of.values()))
        self.of = {x: c - least for x, c in of.items() if c > least}
        if n > least:
            self.of[item] = n - least


def summaries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n) of each task's summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = MisraGries(counters)
        for b in batches:
            for x in b.column("digest").value_counts().to_pylist():
                seen.add(x["values"], x["counts"])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.of), pa.binary()), pa.array(list(seen.of.values()), pa.int64())], names=["digest", "n"])

    return digests.select("digest").mapInArrow(run, "digest binary, n long")


def keepers(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """A row per row of df: doc_id, keep_id, group_size, kept, digest (binary)."""
    rows = store.table(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.unhex(F.sha2(normal(F.col(f"`{text}`")), 256)).alias("digest")), "digests")
    least = rows.count() / (counters + 1)
    frequent = [r.digest for r in summaries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, 2)).select("digest").limit(counters + 1).collect()]
    spark = rows.sparkSession
    winners = rows.join(F.broadcast(spark.createDataFrame([(bytes(d),) for d in frequent], "digest binary")), "digest", "left_semi")
    winners = [tuple(r) for r in winners.groupBy("digest").agg(F.max("doc_id"), F.count("*")).collect()]
    heavy = F.broadcast(spark.createDataFrame([(bytes(d), k, n) for d, k, n in winners], f"digest binary, keep_id {rows.schema['doc_id'].dataType.simpleString()}, group_size long"))
    removed = rows.join(heavy, "digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    both = removed.unionByName(rest.join(groups, "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, one of each group of equal texts, with df's columns.

    Rows that repeat an id and text are told apart by their order in df's files.
    """
    names = df.columns
    marked = df.select(*[F.col(f"`{c}`") for c in names], F.unhex(F.sha2(normal(F.col(f"`{text}`")), 256)).alias("_digest"))
    stay = keepers(df, doc_id, text).where("kept").groupBy("digest").agg(F.first("keep_id").alias("_keep"), F.count("*").alias("_rows"))
    joined = marked.join(stay, (marked["_digest"] == stay["digest"]) & marked[f"`{doc_id}`"].eqNullSafe(stay["_keep"]))
    single = joined.where("_rows = 1").select(*[F.col(f"`{c}`") for c in names])
    again = joined.where("_rows > 1").groupBy("digest").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_row"))
    return single.unionByName(again.select("_row.*"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = keepers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
