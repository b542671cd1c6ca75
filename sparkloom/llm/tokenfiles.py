"""Token ids in files of independent Zstandard frames with a trailing seek table.

A file is a valid Zstandard stream: frames of ids (little-endian unsigned 32-bit), each of whole
documents; a skippable frame with the compressed list of documents, (doc_id, ids, frame)
as signed 64-bit integers; and the public seekable format's table, a skippable frame with each
frame's compressed size, size and the low 32 bits of its XXH64. A reader takes
the tables from the end and decompresses only the frames that hold what it is asked for.

Documents are dealt to files by ranges of doc_id, so the files in order of their part
number, and the documents in each, ascend. Ties on doc_id keep no particular order; null
comes first and is written as the least 64-bit integer. Null and empty texts have the end
id alone. Other columns are dropped. An empty table gives no documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import store
from sparkloom.llm.files import Reader, Writer
from sparkloom.llm.tokens import WORD_BPE, encoder, texts_of

END = 1
#: Bytes of ids after which a frame is closed.
FRAME = 1 << 18
LEVEL = 3
NULL_ID = -(1 << 63)
SEEK_MAGIC, SKIP_MAGIC, LIST_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
MANIFEST = "part int, uri string, n_docs long, n_ids long"


class FrameWriter:
    def __init__(self, out: Writer) -> None:
        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = b"".join(self.open)
            packed = self.zip.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.open, self.held = [], 0

    def finish(self) -> None:
        self.flush()
        listed = self.zip.compress(np.array(self.docs, dtype="<i8").reshape(-1, 3).tobytes())
        self.out.write(struct.pack("<II", LIST_MAGIC, len(listed)) + listed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_MAGIC, len(table)) + table)


class FrameReader:
    """Documents of one file; frames are read and checked when asked for."""

    def __init__(self, uri: str) -> None:
        self.file = Reader(uri)
        end = self.file.size
        n, flags, magic = struct.unpack("<IBI", self.file.read(end - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        at = end - 9 - 12 * n
        self.frames = np.frombuffer(self.file.read(at, 12 * n), dtype="<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        kind, size = struct.unpack("<II", self.file.read(int(self.at[-1]), 8))
        if kind != LIST_MAGIC:
            raise ValueError("no list of documents")
        self.unzip = zstandard.ZstdDecompressor()
        listed = self.unzip.decompress(self.file.read(int(self.at[-1]) + 8, size))
        self.docs = np.frombuffer(listed, dtype="<i8").reshape(-1, 3)
        before = np.cumsum(self.docs[:, 1]) - self.docs[:, 1]
        first = np.searchsorted(self.docs[:, 2], np.arange(n)) if n else np.zeros(0, int)
        self.within = before - before[first][self.docs[:, 2]] if len(self.docs) else before

    def frame(self, k: int) -> bytes:
        packed, size, check = map(int, self.frames[k])
        data = self.unzip.decompress(self.file.read(int(self.at[k]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) in file order, of the wanted ids or of all."""
        now, data = -1, b""
        for (doc, n, k), w in zip(self.docs.tolist(), self.within.tolist(), strict=True):
            if wanted is None or doc in wanted:
                if k != now:
                    now, data = k, self.frame(k)
                yield doc, data[4 * w : 4 * (w + n)]


def write(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE, end: int = END, folder: str | None = None) -> DataFrame:
    """Write the files; their manifest, one row per file."""
    spark = df.sparkSession
    folder = folder or store.scratch(spark, "token-files")
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = store.files_for(src, F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lib, tail = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        first = next(batches, None)
        if first is None:
            return
        total = 0
        with Writer(folder, f"part-{part:06d}.ids.zst") as out:
            frames = FrameWriter(out)
            while first is not None:
                for at in range(0, len(first), 512):
                    b = first.slice(at, 512)
                    for d, ids in zip(b.column("doc_id").to_pylist(), lib.encode(texts_of(b.column("text"))), strict=True):
                        frames.add(NULL_ID if d is None else d, ids + tail)
                        total += len(ids) // 4 + 1
                first = next(batches, None)
            frames.finish()
        yield pa.RecordBatch.from_pylist([{"part": part, "uri": out.uri, "n_docs": len(frames.docs), "n_ids": total}], schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = src.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return store.table(ordered.mapInArrow(run, MANIFEST).where("n_docs > 0"), "token-manifest")


def read(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of the files; with wanted ids, only their frames are read.

    The ids of the files before each are summed from the manifest, which has a row per file.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.select("part", "uri", "n_ids").collect(), key=lambda r: r.part)
    before = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    files = spark.createDataFrame([(r.uri, b) for r, b in zip(rows, before, strict=False)], "uri string, before long").repartition(max(1, len(rows)), "uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column("uri").to_pylist(), b.column("before").to_pylist(), strict=True):
                reader = FrameReader(uri)
                starts = before + np.cumsum(reader.docs[:, 1]) - reader.docs[:, 1]
                if wanted is not None:
                    starts = starts[[d in wanted for d in reader.docs[:, 0].tolist()]]
                held: list[tuple[int | None, bytes]] = []
                done = size = 0

                def batch() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array(starts[done : done + len(held)], pa.int64()), pa.array([len(x) // 4 for _, x in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

                for d, ids in reader.documents(wanted):
                    held.append((None if d == NULL_ID else d, ids))
                    size += len(ids)
                    if size > 1 << 22:
                        yield batch()
                        done, held, size = done + len(held), [], 0
                if held:
                    yield batch()
                reader.file.close()

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    found = read(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


