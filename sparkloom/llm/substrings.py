"""Removal of repeated substrings by suffix arrays of linear grouping.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Each window of that many
bytes has one anchor, its 32-gram with the least hash, the first of equal ones; equal windows have the same
anchor at the same place. Anchors that occur once in all texts have no repeats. The others' contexts, from the
first window of the anchor to the end of the last, are grouped by anchor, equal ones as one class. In
blocks of 32 bytes aligned on the anchor, a group's classes are one string, and neighbours in its
suffix array that share as many blocks as any window holds are compared window by window, by two hashes of
64 bits. The repeated windows are joined into spans of each text.

Several lengths may be asked for at once: an anchor of longer windows is one of shorter windows too, so
one scan, one set of contexts and one suffix array serve them all.

Equal texts are worked on once. A group with more than SPLIT classes is dealt out by parts of 64 windows and
what these all share, so that only classes that agree there meet. Anchors and classes that a large share of all
rows have are joined by a broadcast of bounded size (see skew). Of a run of bytes with a period of at most PERIOD only the first
windows are entered, as the others repeat them, and the run itself goes.

Results: null and empty texts have nothing to remove; texts shorter than the length stay; equal
rows are repeats of each other and lose all bytes if they are long enough; repeated and null ids are
told apart by their texts. Columns of the table other than id and text are kept by remove() and dropped by
report(); theirs may have any names but those that begin with an underscore. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import skew, store
from sparkloom.llm.shingles import mix
from sparkloom.llm.suffixes import suffix_array
from sparkloom.llm.tokens import texts_of

LENGTH = 400
#: Bytes that a run of more than 50 words has where words have four letters and a space on average.
PASSAGE = 250
GRAM = 32
BLOCK = 32
SPLIT, PART = 512, 64
#: Windows whose minima are taken at once, which bounds a task's memory on very long texts.
CHUNK = 1 << 20
#: Bytes of contexts that are handed on at once.
HELD = 4 << 20
#: Symbols of the suffix arrays built at once.
BATCH = 20_000
#: Longest period of a run that is not entered window by window, and how far above its mean the number of anchors must lie for runs to be looked for.
PERIOD, DENSE = 32, 4
_rng = np.random.default_rng(400)
_BYTES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_OTHER = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_OTHER_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_MASK = (1 << 64) - 1


def grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash of the n bytes from each place; n is a power of two."""
    h, width, step = _BYTES[data], 1, _STEP
    while width < n:
        h = h[:-width] * np.uint64(step) + h[width:]
        width, step = width * 2, step * step & _MASK
    return mix(h)


def periodic(data: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Start, end and period of the runs of bytes that hold more windows than their period is long."""
    found: list[tuple[int, int, int]] = []
    for q in range(1, PERIOD + 1):
        for a, z in runs_of(data[q:] == data[:-q]):
            if z - a + 1 >= length and not any(s <= a and z + 1 + q <= e for s, e, _ in found):
                found.append((a, z + 1 + q, q))
    return found


def _windows(data: np.ndarray, lengths: tuple[int, ...], skips: dict[int, np.ndarray]) -> list[list[np.ndarray]]:
    """For each length the hash and place of each anchor, and its first and last window, but for windows to skip."""
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in lengths]
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    for at in range(0, max(0, len(data) - lengths[order[0]] + 1), CHUNK):
        h = grams(data[at : at + CHUNK + lengths[order[-1]] - 1])
        least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        for k in order:
            length = lengths[k]
            span = length - GRAM + 1
            while width * 2 <= span and width < len(least):
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            n = min(len(data) - at, CHUNK + length - 1) - length + 1
            if n <= 0:
                break
            place = np.minimum(least[:n], least[span - width : span - width + n]) if width < span else least[:n]
            place = (place & np.uint64((1 << 24) - 1)).astype(np.int64)
            if length not in skips:
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                last = np.concatenate([first[1:] - 1, [len(place) - 1]])
            else:
                own = np.flatnonzero(~skips[length][at : at + len(place)])
                if not len(own):
                    continue
                new = np.concatenate([[True], (place[own[1:]] != place[own[:-1]]) | (own[1:] != own[:-1] + 1)])
                first, last = own[new], own[np.concatenate([new[1:], [True]])]
            found[k].append((h[place[first]], place[first] + at, first + at, last + at))
    none = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]
    return [[np.concatenate(x) for x in zip(*f, strict=True)] if f else none for f in found]


def anchors(text: bytes, lengths: tuple[int, ...] = (LENGTH,), whole: bool = True) -> tuple[list[np.ndarray], bool]:
    """Hash and place of each anchor, and start and end of its context; and if windows of periodic runs were left out.

    Not whole: only the anchors of the shortest windows, which include the others' unless windows were left out.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    short = min(lengths)
    found = _windows(data, lengths if whole else (short,), {})
    own = found[lengths.index(short) if whole else 0]
    dense = len(own[0]) > DENSE * 2 * len(data) / (short - GRAM + 2) + 16
    runs = {n: r for n in lengths if (r := periodic(data, n))} if dense else {}
    if not whole and not runs:
        return [*own[:3], own[3] + short], False
    if runs:
        skips = {n: np.zeros(len(data), dtype=bool) for n in runs}
        for n, r in runs.items():
            for a, e, q in r:
                skips[n][a + q : e - n + 1] = True
        found = _windows(data, lengths, skips)
    if len(lengths) == 1:
        return [*found[0][:3], found[0][3] + short], bool(runs)
    parts = [[*x[:3], x[3] + n] for x, n in zip(found, lengths, strict=True)]
    h, p, lo, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    p, first, same = np.unique(p, return_index=True, return_inverse=True)
    least, most = lo[first], end[first]
    np.minimum.at(least, same, lo)
    np.maximum.at(most, same, end)
    return [h[first], p, least, most], bool(runs)


def window_hashes(data: np.ndarray, bytes_of: np.ndarray, step: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """A 64-bit hash of the windows of some length at some places."""
    powers, back = np.full(len(data) + 1, np.uint64(step)), np.full(len(data) + 1, np.uint64(pow(step, -1, 1 << 64)))
    powers[0] = back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(bytes_of[data] * np.cumprod(powers)[:-1])])
    return lambda at, length: mix((sums[at + length] - sums[at]) * back[at])


def shared_windows(group: list[int], contexts: list[bytes], places: list[int], lengths: tuple[int, ...] = (LENGTH,), asked: list[int] | None = None) -> list[list[np.ndarray]]:
    """For each length and class, which of its windows another class of its group has at the same distance from the anchor.

    group, contexts, places: of each class its group, bytes and the anchor's place in them. asked: the length that
    a class is compared at, 0 for all.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    marks = [np.zeros(len(data), dtype=bool) for _ in lengths]
    out = [[m[a : a + max(0, n - length + 1)] for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)] for m, length in zip(marks, lengths, strict=True)]
    block_hash = grams(data, BLOCK)
    # blocks aligned on the anchor; t counts them from it
    firsts = [-(p // BLOCK) for p in places]
    numbers = [(n - p) // BLOCK - t for n, p, t in zip(sizes.tolist(), places, firsts, strict=True)]
    cls = np.repeat(np.arange(len(contexts)), numbers)
    t = np.concatenate([np.arange(f, f + n) for f, n in zip(firsts, numbers, strict=True)])
    at = begins[cls] + np.array(places)[cls] + BLOCK * t
    own_group = np.array(group, dtype=np.int64).view(np.uint64)
    symbols = mix(block_hash[at] + mix(own_group[cls] * np.uint64(1024) + (t + 512).astype(np.uint64)))
    _, ranks, often = np.unique(symbols, return_inverse=True, return_counts=True)
    # blocks that no other class has end all runs, so stretches of too few others are left out
    edge = np.ones(len(ranks) + 1, dtype=bool)
    edge[1:-1] = (often[ranks[1:]] > 1) != (often[ranks[:-1]] > 1)
    edge[1:-1] |= cls[1:] != cls[:-1]
    edge = np.flatnonzero(edge)
    long = (often[ranks[edge[:-1]]] > 1) & (np.diff(edge) >= (min(lengths) - BLOCK + 1) // BLOCK)
    kept = np.repeat(long, np.diff(edge))
    ranks, cls, at = ranks[kept] + 1, cls[kept], at[kept]
    if not len(ranks):
        return out
    # a separator of its own after each stretch, and the least symbol at the end
    ends = np.cumsum(np.diff(edge)[long])
    text = np.insert(ranks, ends, ranks.max() + 1 + np.arange(len(ends)))
    owner = np.insert(np.arange(len(ranks)), ends, -1)
    order = np.array(suffix_array([*text.tolist(), 0]))[1:]
    hashes = [window_hashes(data, table, step) for table, step in ((_BYTES, _STEP), (_OTHER, _OTHER_STEP))]
    for length, mark in zip(lengths, marks, strict=True):
        full = (length - BLOCK + 1) // BLOCK
        padded = np.concatenate([text, -1 - np.arange(full)])
        runs = sliding_window_view(padded, full)[order]
        same = (runs[1:] == runs[:-1]).all(axis=1)
        hit = np.zeros(len(order), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        k = owner[order[hit]]
        k = k[k >= 0]
        if asked is not None:
            k = k[np.isin(np.array(asked)[cls[k]], (0, length))]
        if not len(k):
            continue
        # the windows whose first whole block is a shared one: BLOCK places up to its start
        starts = (at[k][:, None] - np.arange(BLOCK)).ravel()
        owners = np.repeat(cls[k], BLOCK)
        inside = (starts >= begins[owners]) & (starts <= (begins + sizes)[owners] - length)
        starts, owners = starts[inside], owners[inside]
        offset = starts - begins[owners] - np.array(places)[owners]
        base = mix(own_group[owners] * np.uint64(4096) + (offset + 2048).astype(np.uint64))
        key = np.empty(len(starts), dtype=[("a", np.uint64), ("b", np.uint64)])
        key["a"], key["b"] = (mix(h(starts, length) + base) for h in hashes)
        by = np.lexsort((key["b"], key["a"]))
        like = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(by), dtype=bool)
        twice[by[1:]] |= like
        twice[by[:-1]] |= like
        mark[starts[twice]] = True
    return out


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, maximal and ascending [start, end) spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[at[k] : at[k + 1]] for k in range(0, len(at), 2))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def changed(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """(text_key, found) of the texts that lose bytes; found: n_removed, n_spans and kept (null: the text as it is) for each length.

    docs: doc_id long, text string without nulls.
    """
    src = docs.withColumn("text_key", _key(F.col("text")))
    short = min(lengths)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                texts = texts_of(b.column("text"))
                found = [anchors(t, lengths, False) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([len(t) for t in texts], pa.int64()), pa.array([r for _, r in found], pa.bool_()), pa.array([a[0].view(np.int64) for a, _ in found], pa.list_(pa.int64())), pa.array([a[1] for a, _ in found], pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_bytes", "periodic", "hashes", "places"])

    seen = store.table(src.mapInArrow(scan, "doc_id long, text_key binary, n_bytes long, periodic boolean, hashes array<long>, places array<long>"), "anchors")
    texts = seen.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("periodic").alias("periodic"), F.first(F.struct("hashes", "places")).alias("a"))
    texts = store.table(texts, "texts")
    each = texts.select("text_key", F.inline(F.arrays_zip("a.hashes", "a.places")).alias("anchor", "place"))
    often = store.table(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often")
    wanted = store.table(skew.join(each, often, ["anchor"]).groupBy("text_key").agg(F.collect_list("place").alias("wanted")).join(texts.select("text_key", "first"), "text_key"), "wanted")

    def at_first(table: DataFrame) -> DataFrame:
        """Texts of the keys in table, from the document where each comes first; twice where that repeats.

        Never a broadcast of the lists: a long text's list has no bound. Texts that are surely not asked for are not shuffled.
        """
        asked = table.withColumnRenamed("text_key", "_key").hint("merge")
        some = skew.sieved(src, F.col("text_key"), table, "text_key").where("_maybe").drop("_maybe")
        return some.join(asked, some["doc_id"].eqNullSafe(asked["first"]) & (some["text_key"] == asked["_key"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
        names = ["anchor", "ctx", "text_key", "at", "place", "context"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)

        rows: list[tuple] = []
        held = 0
        for whole in batches:
            for at in range(0, len(whole), 64):
                b = whole.slice(at, 64)
                for key, t, want in zip(b.column("text_key").to_pylist(), texts_of(b.column("text")), b.column("wanted").to_pylist(), strict=True):
                    (h, p, lo, hi), _ = anchors(t, lengths)
                    for k in np.flatnonzero(np.isin(p, want)).tolist():
                        c = t[lo[k] : hi[k]]
                        rows.append((int(h[k].view(np.int64)), xxhash.xxh3_128_digest(c), key, int(lo[k]), int(p[k] - lo[k]), c))
                        held += len(c)
                        if held > HELD:
                            yield out(rows)
                            rows, held = [], 0
        yield out(rows)

    own = ["anchor", "ctx", "place"]
    cuts = store.table(at_first(wanted).select("text_key", "text", "wanted").mapInArrow(cut, "anchor long, ctx binary, text_key binary, at long, place int, context binary"), "contexts")
    place_of = F.struct("text_key", "at")
    classes = cuts.groupBy(*own).agg((F.min(place_of) != F.max(place_of)).alias("twice"), F.count("*").alias("n"), F.first("context").alias("context"))
    classes = store.table(classes, "classes")
    several = store.table(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "several")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, class, part, place, length, bytes): classes, or parts of them where an anchor has many; a part is told by its first window."""
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for whole in batches:
            for at in range(0, len(whole), 256):
                rows = []
                for r in whole.slice(at, 256).to_pylist():
                    c, p, me = r["context"], r["place"], (r["anchor"], r["ctx"], r["place"])
                    if r["classes"] <= SPLIT:
                        rows.append((r["anchor"], *me, 0, p, 0, c))
                        continue
                    for length in lengths:
                        far = len(c) - length
                        for d in range((p - far) // PART, p // PART + 1):
                            # windows that start from d * PART to PART - 1 more bytes before the anchor, and what all of them cover
                            low, high = p - d * PART - PART + 1, p - d * PART
                            a, z = max(0, low), min(far, high)
                            if a <= z:
                                group = xxhash.xxh3_64_intdigest(c[max(0, high) : low + length], seed=(r["anchor"] + d * 0x9E3779B9 + length * 0x85EBCA6B) & _MASK)
                                rows.append((group - (1 << 63), *me, a, p - a, length, c[a : z + length]))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, types, strict=True)], names=["group", *own, "part", "own_place", "length", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(class, first, last): runs of windows shared with another class; groups come one after the other, equal parts of a group as one."""

        def work(rows: list[tuple]) -> pa.RecordBatch:
            # equal parts repeat each other whole; one of them is compared with the rest
            alike: dict[tuple, list[tuple]] = {}
            for r in rows:
                alike.setdefault((r[0], r[5], r[6], r[7]), []).append(r)
            out = []
            for (_, _, asked, c), those in alike.items():
                if len(those) > 1:
                    for length in lengths:
                        if asked in (0, length) and len(c) >= length:
                            out += [(*r[1:4], length, r[4], r[4] + len(c) - length) for r in those]
            one = list(alike)
            flags = shared_windows([r[0] for r in one], [r[3] for r in one], [r[1] for r in one], lengths, [r[2] for r in one])
            for length, by_class in zip(lengths, flags, strict=True):
                for key, f in zip(one, by_class, strict=True):
                    if f.any():
                        for r in alike[key]:
                            out += [(*r[1:4], length, r[4] + s, r[4] + e) for s, e in runs_of(f)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[*own, "length", "first", "last"])

        ready: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for whole in batches:
            for at in range(0, len(whole), 1024):
                for r in zip(*(c.to_pylist() for c in whole.slice(at, 1024).columns), strict=True):
                    if group and r[0] != group[0][0]:
                        if len(group) > 1:
                            ready += group
                            size += sum(len(x[7]) for x in group) // BLOCK
                        group = []
                        if size >= BATCH:
                            yield work(ready)
                            ready, size = [], 0
                    group.append(r)
        if len(group) > 1:
            ready += group
        if ready:
            yield work(ready)

    dealt = skew.join(classes.drop("n"), several, ["anchor"], "classes").select(*own, "context", "classes").mapInArrow(deal, "group long, anchor long, ctx binary, place int, part int, own_place int, length int, bytes binary")
    runs = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "anchor long, ctx binary, place int, length int, first long, last long")
    whole = classes.where("twice").select(*own, "n", F.octet_length("context").alias("size"), F.explode(F.array(*map(F.lit, lengths))).alias("length")).where("size >= length")
    whole = whole.select(*own, "n", "length", F.lit(0).cast("long").alias("first"), (F.col("size") - F.col("length")).cast("long").alias("last"))
    by_class = runs.withColumn("n", F.lit(1).cast("long")).unionByName(whole).groupBy(*own).agg(F.max("n").alias("n"), F.collect_set(F.struct("length", "first", "last")).alias("runs"))
    placed = skew.join(cuts.select(*own, "text_key", "at"), store.table(by_class, "runs"), own).select("text_key", "at", F.inline("runs"))
    spans = placed.groupBy("text_key").agg(F.collect_list(F.struct("length", (F.col("at") + F.col("first")).alias("s"), (F.col("at") + F.col("last") + F.col("length")).alias("e"))).alias("spans"))
    spans = texts.where("n = 1").select("text_key", "first", "periodic").join(spans, "text_key", "left").where("spans is not null or periodic").select("text_key", "first", "spans", "periodic")
    spans = store.table(spans, "spans")
    result = "array<struct<n_removed: long, n_spans: long, kept: binary>>"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))
        for whole in batches:
            for at in range(0, len(whole), 64):
                b = whole.slice(at, 64)
                rows = []
                for t, listed, runs in zip(texts_of(b.column("text")), b.column("spans").to_pylist(), b.column("periodic").to_pylist(), strict=True):
                    row = []
                    for length in lengths:
                        own_runs = [(a, e) for a, e, _ in periodic(np.frombuffer(t, dtype=np.uint8), length)] if runs else []
                        found = merged([(x["s"], x["e"]) for x in listed or [] if x["length"] == length] + own_runs)
                        kept = without(t, found) if found else None
                        row.append({"n_removed": len(t) - len(kept) if found else 0, "n_spans": len(found), "kept": kept})
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(rows, kind)], names=["text_key", "found"])

    partly = at_first(spans).select("text_key", "text", "spans", "periodic").mapInArrow(cut_out, f"text_key binary, found {result}")
    all_ = [F.when(F.col("n_bytes") >= n, F.struct(F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))).otherwise(F.struct(F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept"))) for n in lengths]
    wholly = texts.where((F.col("n") > 1) & (F.col("n_bytes") >= short)).select("text_key", F.array(*all_).alias("found"))
    return store.table(partly.unionByName(wholly), "changed")


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _with_found(df: DataFrame, key: Column, new: DataFrame) -> DataFrame:
    """df with the column found of new (text_key, found), null where the text is as it was; only rows that may be in new are shuffled."""
    some = skew.sieved(df.withColumn("_key", key), F.col("_key"), new, "text_key")
    hit = some.where("_maybe").drop("_maybe").join(new.withColumnRenamed("text_key", "_other").withColumnRenamed("found", "_found"), F.col("_key") == F.col("_other"), "left").drop("_other")
    return hit.unionByName(some.where(~F.col("_maybe")).drop("_maybe").withColumn("_found", F.lit(None).cast(new.schema["found"].dataType)))


def _left(at: int, text: Column) -> Column:
    """What is left of a text at a length; a code point that a removal cuts is replaced by U+FFFD."""
    kept = F.get("_found", F.lit(at))["kept"]
    return F.when(kept.isNull(), text).otherwise(F.make_valid_utf8(kept.cast("string")))


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """df with the remaining bytes of each text; a code point that a removal cuts is replaced by U+FFFD."""
    new = changed(_texts(df, doc_id, text), (length,))
    found = _with_found(df, _key(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), new)
    return found.select(*[_left(0, F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """A row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256; n_passage_bytes, n_passages and text.

    The last three are of a removal at the shorter length `passage`: the bytes and runs that it takes out,
    and the text that it leaves.
    """
    docs = _texts(df, doc_id, text)
    found = _with_found(docs, _key(F.col("text")), changed(docs, (length, passage)))
    of = lambda k, c: F.coalesce(F.get("_found", F.lit(k))[c], F.lit(0).cast("long"))
    kept = F.get("_found", F.lit(0))["kept"]
    return found.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), of(0, "n_removed").alias("n_removed"), of(0, "n_spans").alias("n_spans"),
        F.when(kept.isNull(), F.lower(F.hex("_key"))).otherwise(F.sha2(kept, 256)).alias("kept_sha256"),
        of(1, "n_removed").alias("n_passage_bytes"), of(1, "n_spans").alias("n_passages"), _left(1, F.col("text")).alias("text"))


def op3_substring_removal(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
