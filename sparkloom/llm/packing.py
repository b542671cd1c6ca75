"""Best-fit packing of token sequences by hierarchical residual packing.

A document's tokens are its ids and the end id. A document of more than SIZE tokens is cut
into pieces of SIZE tokens of which the first takes the remainder. Each partition packs
its pieces best-fit, longest first, into bins of SIZE tokens, and bins with at most
SLACK free tokens are sequences. The other bins become items: groups of FAN partitions pack
them best-fit again, then FAN times as many, until one group is left. What is left
shrinks by each round, as a bin that is more than half full joins few others. When the last group is more
than a task takes, it is dealt out anew, by another hash, in further rounds until one task takes it or a round joins
none. The bins that no round could fill are sequences too.

Results: null and empty texts are one piece, the end id; a piece is a row, so repeated
rows are packed one by one; null ids pass; other columns are dropped. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import store
from sparkloom.llm.tokens import BYTE_BPE, encoder, texts_of

SIZE = 1024
END = 2
SLACK = 4
FAN = 8
#: Most bins that one task takes in a round; a group beyond it is dealt out, and the rounds then go on.
ROUND_BINS = 2_000_000


def best_fit(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item, longest first into the fullest bin that takes it, and each bin's fill."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, places, fill = [0] * len(lengths), [0] * len(lengths), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r: a bin has r tokens free
    for k in order:
        n = lengths[k]
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[k], places[k] = b, fill[b]
        fill[b] += n
        if left := room - n:
            free[left].append(b)
            some |= 1 << left
    return bins, places, fill


def pieces(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, end: int = END, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary, little-endian unsigned 32-bit) if keep_ids."""
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long" + ", ids binary" * keep_ids

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.array([end], dtype="<u4").tobytes()
        rows: list[tuple] = []
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                for d, ids in zip(b.column("doc_id").to_pylist(), lib.encode(texts_of(b.column("text"))), strict=True):
                    ids += tail
                    for k, (s, n) in enumerate(pieces(len(ids) // 4, size)):
                        own = ids[4 * s : 4 * (s + n)]
                        rows.append((d, k, s, n, zlib.crc32(own), own if keep_ids else None))
        bins, places, fill = best_fit([r[3] for r in rows], size)
        cols = list(zip(*rows, strict=True)) or [()] * 6
        data = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()), "ids_crc32": pa.array(cols[4], pa.int64())}
        data |= {"bin": pa.array([(part << 32) + b for b in bins], pa.int64()), "offset": pa.array(places, pa.int64()), "fill": pa.array([fill[b] for b in bins], pa.int64())}
        if keep_ids:
            data["ids"] = pa.array(cols[5], pa.binary())
        yield from pa.table(data).to_batches(max_chunksize=65536)

    placed = store.table(src.mapInArrow(local, fields), "pieces")
    moved = _rounds(placed, size)
    out = placed.join(moved, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), *["ids"] * keep_ids)
    return out


def _rounds(placed: DataFrame, size: int) -> DataFrame:
    """(bin, sequence_id, base) of the local bins with room that came into another bin; tree-merged."""
    spark = placed.sparkSession
    width = placed.select(F.max(F.shiftright("bin", 32))).first()[0]
    # item: a bin as its round knows it; of: the local bin; base: where the local bin's tokens begin in item
    loose = store.table(
        placed.where(F.col("fill") < size - SLACK).groupBy("bin").agg(F.first("fill").alias("fill"))
        .select(F.col("bin").alias("item"), "fill", F.shiftright("bin", 32).alias("part")), "loose")
    steps = []
    width = (width or 0) + 1
    turn, shares = 0, 1
    while width > 1 or shares > 1:
        turn += 1

        def merge(t: pa.Table) -> pa.Table:
            t = t.sort_by([("fill", "descending"), ("item", "ascending")])
            items = t.column("item").to_pylist()
            bins, places, fill = best_fit(t.column("fill").to_pylist(), size)
            head: dict[int, int] = {}
            for b, i in zip(bins, items, strict=True):
                head.setdefault(b, i)
            return pa.table({"item": pa.array(items, pa.int64()), "head": pa.array([head[b] for b in bins], pa.int64()), "base": pa.array(places, pa.int64()), "fill": pa.array([fill[b] for b in bins], pa.int64()), "part": t.column("part"), "share": t.column("share")})

        grouped = loose.withColumn("part", F.expr(f"part div {FAN}"))
        sizes = grouped.groupBy("part").agg(F.ceil(F.count("*") / ROUND_BINS).alias("shares"))
        dealt = grouped.join(F.broadcast(sizes), "part").withColumn("share", F.pmod(F.xxhash64("item", F.lit(turn)), F.col("shares"))).drop("shares")
        step = store.table(dealt.groupBy("part", "share").applyInArrow(lambda t: merge(t), "item long, head long, base long, fill long, part long, share long"), "round")
        steps.append(step)
        shares = step.agg(F.max("share")).first()[0]
        shares = 1 if shares is None or (width == 1 and not step.where("item <> head").limit(1).count()) else shares + 1
        loose = step.where((F.col("item") == F.col("head")) & (F.col("fill") < size - SLACK)).select("item", "fill", "part")
        width = -(-width // FAN)
    moved = None
    for step in steps:
        own = step.where("item <> head").select(F.col("item").alias("bin"), F.col("head").alias("sequence_id"), "base")
        if moved is None:
            moved = own
            continue
        later = step.where("item <> head").select(F.col("item").alias("sequence_id"), "head", F.col("base").alias("more"))
        moved = moved.join(later, "sequence_id", "left").select("bin", F.coalesce("head", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")).unionByName(own)
    return moved if moved is not None else spark.createDataFrame([], "bin long, sequence_id long, base long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
