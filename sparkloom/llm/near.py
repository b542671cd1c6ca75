"""MinHash near-deduplication by a multi-index Hamming join of b-bit signatures.

Texts with equal shingle sets are one class first. A class's signature, 64 symbols of 16 bits, is
split into CHUNKS chunks of four symbols. Signatures that differ in at most
RADIUS = 2 * CHUNKS - 1 symbols differ, by the pigeonhole principle, in at most one symbol of some chunk; each
chunk is entered once for each symbol that may be wrong, with that symbol left out, so all such
pairs share a key. At a similarity of 0.75 a pair is further apart with a probability of
about 1e-5. What shares a key is confirmed on the full sets (see linking).

Results: null texts and texts without words have an empty set and are linked with nothing;
of equal rows all but one are copies; a null id never names a component unless it has no
other; repeated ids are told apart. Other columns are dropped by rows_of, kept by
deduplicate. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import linking, skew, store
from sparkloom.llm.shingles import SYMBOLS, mix, shingle_set, signature
from sparkloom.llm.tokens import texts_of

PERCENT = 75
CHUNKS = SYMBOLS // 4
RADIUS = 2 * CHUNKS - 1
_WEIGHTS = np.random.default_rng(77).integers(1, 1 << 63, size=(CHUNKS, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest and signature of each text's set."""
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            sets = [shingle_set(t) for t in texts_of(b.column("text"))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "size", "digest", "sig"]).append_column("md5", b.column("md5"))


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """A row of 4 * CHUNKS keys for each signature: chunk, left-out symbol and the others."""
    s = sigs.reshape(-1, CHUNKS, 4).astype(np.uint64) + np.uint64(1)
    terms = mix(s * _WEIGHTS)
    total = terms.sum(axis=2, dtype=np.uint64)[:, :, None]
    # each key sums the chunk's three other terms, with the left-out place and chunk mixed in
    places = np.arange(4 * CHUNKS, dtype=np.uint64).reshape(CHUNKS, 4) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total - terms + places).reshape(len(s), -1)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            if len(b):
                keys = chunk_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u2"))
                ids = np.repeat(b.column("id").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def rows_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per row of df: doc_id, n_shingles, component_id, md5 of its text, and root, its component (null for an empty set)."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = store.table(docs.withColumn("md5", text_md5("text")).mapInArrow(signed, "doc_id long, size long, digest binary, sig binary, md5 string"), "signatures")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = store.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = store.table(classes.join(ids, "id").select("id", "digest", F.col("first").alias("doc_id")), "asked")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 1024):
                    b = whole.slice(at, 1024)
                    sets = [shingle_set(t).astype("<u8").tobytes() for t in texts_of(b.column("text"))]
                    right = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, b.column("digest").to_pylist(), strict=True)])
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "set"]).filter(right)

        some = skew.sieved(docs, F.col("doc_id"), wanted, "doc_id").where("_maybe")
        found = some.join(wanted.hint("merge"), some["doc_id"].eqNullSafe(wanted["doc_id"]))
        return found.select("id", "digest", "text").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])

    items = classes.select("id", "size", "sig")
    found = linking.links(items, items.mapInArrow(keyed, "key long, id long"), sets_of, percent, RADIUS)
    root = linking.components(found)
    named = classes.join(root, "id", "left").select("digest", "first", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("digest", "component_id", "root")
    out = rows.select("doc_id", F.col("size").alias("n_shingles"), "digest", "md5").join(of, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "md5", "root")


def text_md5(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, one of each component and all without words, with df's columns.

    The least id of a component stays, null last; of its rows with that id the least MD5 of the text; of
    rows equal in both the least by all columns.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "md5")
    stay = rows_of(df, doc_id, text).where("root is not null").groupBy("root").agg(F.min(order).alias("s"), F.count("*").alias("n"))
    stay = store.table(stay.select(F.col("s.doc_id").alias("_id"), F.col("s.md5").alias("_md5"), F.col("n").alias("_n")), "stay")
    left = df.join(stay, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_id")) & (text_md5(text) == F.col("_md5")))
    many = left.where("_n > 1").groupBy("_id", "_md5").agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    wordless = ~F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return left.where("_n = 1").select(*names).unionByName(many).unionByName(df.where(wordless))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
