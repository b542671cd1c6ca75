"""Language-model scores of whole documents.

Token counts cover all training documents. The model, a gated recurrent network (see recurrent), predicts the most
frequent tokens and one symbol for all others; what that symbol stands for is predicted by its
smoothed share of the counts, and one unseen token has a share too, so the scores are those of
one distribution. It learns in ROUNDS rounds, which part the training documents by hash, so that each
is learned from in one of them; every task trains on its own, and the tasks' weights are averaged. The counts of
the most frequent tokens, at most TOP, are broadcast; rarer tokens are joined with their counts.

Results: A-Z is lower-cased; null and empty texts are the end token alone; a null id counts as
an empty one for the split; repeated rows are scored one by one. Other columns are dropped. An
empty table gives no rows; without training tokens each known count is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import recurrent, store
from sparkloom.llm.tokens import texts_of

#: Tokens whose counts are broadcast, at about 30 bytes each.
TOP = 1 << 17
#: Distinct tokens that a task counts before it hands them on.
FLUSH = 300_000
#: Steps of the histogram of counts for each doubling.
FINE = 64
ROUNDS = 3
#: Bytes of a block of weights, and groups in which blocks are averaged first.
PIECE, GROUPS = 1 << 16, 64
#: Bytes of documents that are scored side by side.
SIDE_BYTES = 24 << 20
END = b""


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(END)
    return found


def counts_of(docs: DataFrame) -> DataFrame:
    """(token binary, n) over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return b

        for whole in batches:
            for at in range(0, len(whole), 512):
                for t in texts_of(whole.slice(at, 512).column("text")):
                    seen.update(_tokens(t))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The tokens whose counts are above a cut that at most `most` tokens pass, most frequent first.

    The cut comes from a histogram of the counts' logarithms, of at most 64 * FINE rows, so what
    reaches the driver is bounded whatever the number of tokens or tasks.
    """
    level = F.floor(F.log2("n") * FINE).cast("int")
    held = sorted(((r.level, r.tokens) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()), reverse=True)
    cut = None
    for at, tokens in held:
        if (most := most - tokens) < 0:
            break
        cut = at
    if cut is None:
        return []
    return sorted(((bytes(r.token), r.n) for r in counts.where(level >= cut).select("token", "n").collect()), key=lambda x: (-x[1], x[0]))


class _Places(dict):
    def __missing__(self, key: bytes) -> int:
        return -1


_places: dict[int, _Places] = {}


def _placed(top) -> _Places:
    """Rank of each frequent token, once in a worker process for each broadcast."""
    if id(top) not in _places:
        _places.clear()
        _places[id(top)] = _Places((w, k) for k, (w, _) in enumerate(top.value))
    return _places[id(top)]


def _ranks(of: _Places, tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(of.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of documents that are scored side by side."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        done = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, done + SIDE_BYTES, side="right")) - at)
        yield batch.slice(at, n)
        at += n


def _symbols(ranks: np.ndarray) -> np.ndarray:
    last = recurrent.SYMBOLS - 1
    return np.where((ranks < 0) | (ranks >= last), last, ranks)


def train(docs: DataFrame, top, counts: np.ndarray, rounds: int = ROUNDS) -> recurrent.Params:
    """The averaged weights; each of docs is trained on in one round."""
    p = recurrent.initial(counts)
    end = int(_symbols(_ranks(_Places((w, k) for k, (w, _) in enumerate(top.value)), [END]))[0])
    for k in range(rounds):
        start = recurrent.packed(p)

        def run(batches: Iterator[pa.RecordBatch], start=start, p=p) -> Iterator[pa.RecordBatch]:
            of = _placed(top)
            trainer = recurrent.Trainer(recurrent.unpacked(start, p), end)
            for whole in batches:
                for at in range(0, len(whole), 1024):
                    trainer.train([_symbols(_ranks(of, _tokens(t))) for t in texts_of(whole.slice(at, 1024).column("text"))])
            trainer.finish()
            if trainer.tokens:
                flat = recurrent.packed(trainer.p).astype(np.float64) * trainer.tokens
                size = PIECE // 8
                parts = [flat[a : a + size].tobytes() for a in range(0, len(flat), size)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([trainer.tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "sums"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, dtype=np.float64) for x in t.column("sums").to_pylist())
            return pa.table({"block": t.column("block").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k).select("text")
        sums = own.mapInArrow(run, "block int, n long, sums binary").withColumn("g", F.spark_partition_id() % GROUPS)
        for keys in (["block", "g"], ["block"]):
            sums = sums.groupBy(*keys).applyInArrow(add, "block int, n long, sums binary").withColumn("g", F.lit(0)) if keys == ["block"] else sums.groupBy(*keys).applyInArrow(add, "block int, n long, sums binary")
        found = sums.select("block", "n", "sums").orderBy("block").collect()
        if not found:
            continue
        p = recurrent.unpacked(np.concatenate([np.frombuffer(r.sums, dtype=np.float64) / r.n for r in found]), p)
    return p


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", top_size: int = TOP) -> DataFrame:
    """A row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    learned = docs.where(~held_out("doc_id"))
    counts = store.table(counts_of(learned), "counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    first = most_frequent(counts, top_size)
    top = spark.sparkContext.broadcast(first)
    last = recurrent.SYMBOLS - 1
    head = np.zeros(recurrent.SYMBOLS)
    head[: min(last, len(first))] = [n for _, n in first[:last]]
    n_head = int(head.sum())
    head[last] = total - n_head + 0.5 * max(0, distinct - last)
    tail = total - n_head + 0.5 * (max(0, distinct - last) + 1)
    weights = train(learned, top, head)
    flat = recurrent.packed(weights)
    share = np.log10(np.array([n for _, n in first] or [0]) + 0.5)
    whole = np.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, p = _placed(top), recurrent.unpacked(flat, weights)
        end = int(_symbols(_ranks(of, [END]))[0])
        for big in batches:
            for b in _slices(big):
                # a document's tokens are held one document at a time, their ranks and the rare ones all along
                ranks, rare = [], []
                for t in texts_of(b.column("text")):
                    w = _tokens(t)
                    r = _ranks(of, w)
                    ranks.append(r)
                    rare.append([w[i] for i in np.flatnonzero(r < 0).tolist()])
                found = recurrent.score(p, [_symbols(r) for r in ranks], end) / np.log(10)
                base, known = [], []
                for k, r in enumerate(ranks):
                    seen = r[r >= 0]
                    base.append(float(share[seen].sum() - len(r) * whole))
                    known.append(len(seen))
                    low = seen[seen >= last]
                    found[k] += share[low].sum() - (len(low) + len(r) - len(seen)) * np.log10(tail)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([len(r) for r in ranks], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(found, pa.float64()), pa.array(rare, pa.list_(pa.binary()))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>")
    part = store.table(store.table(part, "scores").withColumn("uid", F.monotonically_increasing_id()), "scores")
    rare = part.select("uid", F.explode("rare").alias("token")).join(counts.withColumnRenamed("n", "c"), "token", "left")
    more = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("also"))
    out = part.drop("rare").join(more, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("also")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + zero("more")).alias("base_score"), (F.col("score") + zero("more")).alias("score"))


def op7_recurrent_scores(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
