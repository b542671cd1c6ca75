"""Links between similar sets: candidates from shared keys, exact confirmation, components.

Members of a bucket, the items with a key, are first linked to the bucket's least
item alone. Where the confirmed links leave several components in a bucket, its
members go to a cluster with those of all such buckets that hang together with it, and the clusters'
members of different components are compared in blocks, by signature, sizes and
then whole sets. So each pair in a bucket is confirmed, joined already or ruled out, while
only links that join two components leave a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import skew, store
from sparkloom.llm.shingles import similar

#: Members of a block when the rest of a bucket is compared.
BLOCK = 1024


def components(links: DataFrame) -> DataFrame:
    """(id, root) of the items in links (a, b): the least item reachable.

    Large-star and small-star rounds, each with its result in the shared folder. A hub's edges are joined
    by a broadcast of bounded size (see skew). Null ends link nothing.
    """
    edges = store.table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store.table(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        # done when every item is a centre, whose neighbours are all larger, or has one neighbour
        if not least.where("m < a and n > 1").limit(1).count():
            return least.select(F.col("a").alias("id"), F.col("m").alias("root"))
        # large star: each item's larger neighbours point to its least
        large = store.table(skew.join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "star")
        # small star: each item and its smaller neighbours point to its least
        least = store.table(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = skew.join(large, least, ["a"])
        edges = store.table(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")


def confirmed(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    ids = store.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = store.table(sets_of(ids), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            held = [similar(np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8"), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(held))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return store.table(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def links(items: DataFrame, keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 75, most: int | None = None) -> DataFrame:
    """Confirmed links (a, b) that connect what the buckets hold.

    items: id long, size long, sig binary. keys: key long, id long. sets_of: gives (id, set binary) of a
    table with id. most: pairs whose signatures differ in more symbols are not compared further; None
    compares all.
    """
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    members = store.table(keys.join(buckets, "key").select("key", "id", "hub"), "members")
    size = items.select("id", "size")
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(size.select(F.col("id").alias("a"), F.col("size").alias("m")), "a").join(size.select(F.col("id").alias("b"), F.col("size").alias("n")), "b")
    pairs = store.table(pairs.where(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).select("a", "b"), "pairs")
    first = confirmed(pairs, sets_of, percent)
    root = components(first)

    placed = members.join(root, "id", "left").select("key", "id", "hub", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key")
    open_ = store.table(placed.join(mixed, "key").select("id", "hub", "root"), "open")
    # items whose open buckets hang together are compared with each other, each set sent once per block
    near = components(open_.select(F.col("id").alias("a"), F.col("hub").alias("b"))).select("id", F.col("root").alias("cluster"))
    near = near.join(open_.groupBy("id").agg(F.first("root").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    near = store.table(near, "clusters")
    blocks = near.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rest = near.join(blocks, "cluster").join(items, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("cluster", "id", "root", "size", "sig", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    sets = store.table(sets_of(near.select("id")), "sets")

    def compare(t: pa.Table) -> pa.Table:
        pairs = spanning(*(t.column(c).to_numpy() for c in ("id", "root", "size")), t.column("own").to_numpy() if t.column("low")[0] != t.column("high")[0] else None, np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u2").reshape(t.num_rows, -1), [np.frombuffer(x, dtype="<u8") for x in t.column("set").to_pylist()], percent, most)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    more = rest.join(sets, "id").groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long")
    return first.unionByName(store.table(more, "links"))


def spanning(ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, block: np.ndarray | None, sigs: np.ndarray, sets: list[np.ndarray], percent: int, most: int | None) -> list[tuple[int, int]]:
    """Links between similar items that earlier links and roots do not join yet; with blocks, only across them."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    ends = np.cumsum([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(codes, ends[:-1])
    marked = np.zeros(codes.max() + 1, dtype=np.int32)
    out = []
    for i in range(len(ids) - 1):
        now = np.array([find(r) for r in roots[i:].tolist()])
        js = i + np.flatnonzero((now != now[0]) & (100 * np.minimum(sizes[i:], sizes[i]) >= percent * np.maximum(sizes[i:], sizes[i])))
        if block is not None:
            js = js[block[js] != block[i]]
        if most is not None and len(js):
            js = js[(sigs[js] != sigs[i]).sum(axis=1) <= most]
        if not len(js):
            continue
        marked[parts[i]] = 1
        lengths = np.array([len(parts[j]) for j in js])
        both = np.add.reduceat(marked[np.concatenate([parts[j] for j in js])], np.cumsum(lengths) - lengths)
        marked[parts[i]] = 0
        for j in js[100 * both >= percent * (len(parts[i]) + lengths - both)].tolist():
            p, q = find(int(roots[i])), find(int(roots[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
    return out
