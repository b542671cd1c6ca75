"""Substring deduplication by paragraph MinHash banding.

Paragraphs are lines of at least MIN_WORDS words. Paragraphs with equal sets of five-word shingles are
one class. A class's signature is cut into BANDS bands of ROWS symbols, tuned for
recall: two paragraphs with a Jaccard similarity of 0.75 share a band with a probability of
1 - (1 - 0.75**3)**16, above 0.9998. Classes that share a band are confirmed on their full sets (see
linking), and of each component of similar paragraphs the first by document id and
line stays; the others are removals.

Passages are runs of words that repeat whatever surrounds them, within lines or across line breaks. Units of
UNIT words are chosen by their hashes alone, such that any RUN words in a row hold a whole unit; units with
equal hashes (128 bits) are equal, and of each the first place stays, those outside removed lines before
others. Units that follow each other in a text and in the one that stays are one passage, so every
repeated run of RUN words or more gives a passage of UNIT words at least; shorter runs may give one. A word that a passage that stays
covers stays too. Passages have the number of their first word in first_word, which is null for paragraphs.

Results: a null or empty text has no paragraphs; a paragraph that repeats in one document is a
repeat like any other; a null id comes last, so that it stays only if it has no other;
rows that repeat an id are one document, so equal paragraphs on the same line of them all stay. Other columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import linking, skew, store
from sparkloom.llm.shingles import mix, shingle_set, shingle_sets, signatures, word_hashes, words
from sparkloom.llm.tokens import texts_of

MIN_WORDS = 20
PERCENT = 75
BANDS, ROWS = 16, 3
#: Symbols of 48 in which signatures may differ; at a similarity of 0.75 more have a probability of about 1e-6.
MOST = 27
#: Words of a run that cannot be missed, and of a unit.
RUN, UNIT = 50, 25
#: Words of paragraphs whose sets are made at once.
TOGETHER = 1 << 16
_WEIGHTS = np.random.default_rng(78).integers(1, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_PLACES = np.random.default_rng(79).integers(1, 1 << 63, size=(2, UNIT), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def long_lines(text: bytes, least: int) -> Iterator[tuple[int, list[bytes]]]:
    """Line number and words of each paragraph."""
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= 2 * least - 1 and len(found := words(line)) >= least:
            yield k, found


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the chosen units of all texts: the text's place, the number of the first word, first and last line, and two hashes.

    A unit is chosen where its first hash is the least, the first of equal ones, in some run of RUN words of one text.
    """
    found: list[bytes] = []
    begins, sizes, lines = [], [], []
    for t in texts:
        begins.append(len(found))
        own = []
        for x in t.split(b"\n"):
            found += (w := words(x))
            own.append(len(w))
        if (n := len(found) - begins[-1]) < RUN:
            del found[begins[-1] :]
            n, own = 0, []
        sizes.append(n)
        lines.append(np.repeat(np.arange(len(own), dtype=np.int32), own))
    text, line = np.repeat(np.arange(len(texts)), sizes), np.concatenate([np.zeros(0, np.int32), *lines])
    if not found:
        return text, text, line, line, np.zeros((2, 0), dtype=np.uint64)
    h = word_hashes(found)
    n = len(h) - UNIT + 1
    both = np.zeros((2, n), dtype=np.uint64)
    for k in range(UNIT):
        both += h[k : k + n] * _PLACES[:, k : k + 1]
    both = mix(both)
    least, width, span = np.arange(n), 1, RUN - UNIT + 1

    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(both[0, x] <= both[0, y], x, y)

    while width * 2 <= span:
        least = lower(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = lower(least[: len(least) - (span - width)], least[span - width :])
    starts = np.unique(least[text[: len(least)] == text[RUN - 1 :]])
    return text[starts], starts - np.array(begins)[text[starts]], line[starts], line[starts + UNIT - 1], both[:, starts]


def passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """A row per passage of docs (doc_id, text) that has a like elsewhere. gone: (doc_id, line) of removed paragraphs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                if len(b):
                    place, starts, first, last, both = units(texts_of(b.column("text")))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(place)), pa.array(starts, pa.int64()), pa.array(first), pa.array(last), *(pa.array(x.view(np.int64)) for x in both)], names=["doc_id", "at", "line", "last_line", "h", "i"])

    same = ["h", "i"]
    rows = store.table(docs.mapInArrow(cut, "doc_id long, at long, line int, last_line int, h long, i long"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    often = rows.groupBy(*same).agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p <> q").select(*same)
    hit = store.table(rows.join(often, same), "repeated")
    # ids that are null meet each other here
    id_ = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc")]
    weak = hit.select(*id_, "at", F.explode(F.sequence("line", "last_line")).alias("line")).join(gone.select(*id_, "line").distinct(), ["none", "doc", "line"], "left_semi").select("none", "doc", "at").distinct()
    hit = hit.select("*", *id_).join(weak.withColumn("weak", F.lit(True)), ["none", "doc", "at"], "left").withColumn("weak", F.coalesce("weak", F.lit(False)))
    hit = hit.select("doc_id", "none", "at", "line", "weak", *same)
    first = hit.groupBy(*same).agg(F.min(F.struct("weak", "none", "doc_id", "at", "line")).alias("keep"))
    each = hit.join(first, same).select("doc_id", "at", "line", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), (F.col("at") - F.col("keep.at")).alias("shift")).distinct()
    run = ["doc_id", "keep_doc_id", "shift"]
    w = W.partitionBy(*run).orderBy("at")
    each = each.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(w) > UNIT).cast("int"), F.lit(0))).withColumn("passage", F.sum("new").over(w))
    found = each.groupBy(*run, "passage").agg(F.min("at").alias("first_word"), F.max("at").alias("last"), F.min("line").alias("line"), F.min("keep_line").alias("keep_line"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("shift") == 0)
    return found.select("doc_id", "line", (F.col("last") - F.col("first_word") + UNIT).cast("int").alias("n_words"), "keep_doc_id", "keep_line", (~kept).alias("removed"), "first_word")


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 4096):
            b = whole.slice(at, 4096)
            if len(b):
                s = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u2").reshape(len(b), -1)
                s = s[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
                keys = mix(mix(s * _WEIGHTS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], names=["key", "id"])


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per paragraph or passage that has a like elsewhere: doc_id, line, n_words, keep_doc_id, keep_line, removed, first_word."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ["doc_id", "line", "n_words", "size", "digest", "sig"]

        def out(held: list[tuple[int | None, int, list[bytes]]]) -> pa.RecordBatch:
            hashes, begins = shingle_sets([w for _, _, w in held])
            ends = np.append(begins[1:], len(hashes))
            sigs = signatures(hashes, begins, BANDS * ROWS)
            digests = [xxhash.xxh3_128_digest(hashes[a:z].tobytes()) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
            cols = ([d for d, _, _ in held], [k for _, k, _ in held], [len(w) for _, _, w in held], ends - begins, digests, [s.tobytes() for s in sigs])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        held: list[tuple[int | None, int, list[bytes]]] = []
        size = 0
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                for d, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True):
                    for k, w in long_lines(t, least):
                        held.append((d, k, w))
                        size += len(w)
                        if size > TOGETHER:
                            yield out(held)
                            held, size = [], 0
        if held:
            yield out(held)

    rows = store.table(docs.mapInArrow(cut, "doc_id long, line int, n_words int, size long, digest binary, sig binary"), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")
    classes = rows.groupBy("digest").agg(F.min(place).alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    classes = store.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = store.table(classes.join(ids, "id").select("id", "digest", F.col("first.doc_id").alias("_doc"), F.col("first.line").alias("line")), "asked")
        some = skew.sieved(docs, F.col("doc_id"), wanted, "_doc").where("_maybe")
        found = some.join(wanted.hint("merge"), some["doc_id"].eqNullSafe(wanted["_doc"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 1024):
                    b = whole.slice(at, 1024)
                    sets = [shingle_set(t).astype("<u8").tobytes() for t in texts_of(b.column("text"))]
                    right = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, b.column("digest").to_pylist(), strict=True)])
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "set"]).filter(right)

        line = F.expr("get(split(text, '\\n', -1), line)").alias("text")
        return found.select("id", "digest", line).mapInArrow(run, "id long, set binary").dropDuplicates(["id"])

    items = classes.select("id", "size", "sig")
    root = linking.components(linking.links(items, items.mapInArrow(banded, "key long, id long"), sets_of, percent, MOST))
    named = classes.join(root, "id", "left").select("digest", "first", "n", F.coalesce("root", "id").alias("root"))
    groups = named.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").drop("n")
    of = named.join(groups, "root").select("digest", "keep")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line") == F.col("keep.line"))
    lines = store.table(rows.join(of, "digest").select("doc_id", "line", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), (~kept).alias("removed")), "lines")
    return lines.withColumn("first_word", F.lit(None).cast("long")).unionByName(passages(docs, lines.where("removed").select("doc_id", "line")))


def op4_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
