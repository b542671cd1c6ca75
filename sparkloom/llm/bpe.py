"""BPE encoding and decoding of whole texts by tree concatenation.

Texts of up to LEAF bytes are encoded at once. Longer ones are halved until the
parts are that short, the parts are encoded by different tasks, and neighbours are
joined pairwise, level by level: a window around the join is encoded anew and
grows until its tokens agree with the left part's at its start and the right part's at its
end. A sequence whose neighbouring tokens all encode to themselves is the encoding of its
text, so agreement at both ends makes the joined tokens exact.

Results: null and empty texts have no tokens and decode to an empty text; repeated
rows are kept one by one; other columns pass unchanged, except that columns
already named ids or decoded are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from sparkloom.llm.tokens import BYTE_BPE, byte_table, encoder, texts_of

#: Bytes of a leaf; longer texts are halved.
LEAF = 16_384
#: Tokens on either side of a join in the first window.
WINDOW = 24
#: Tokens that must agree at either end of a window.
AGREE = 2

_tables: dict[str, tuple[list[bytes], np.ndarray]] = {}


def table_of(tokenizer: str) -> tuple[list[bytes], np.ndarray]:
    if tokenizer not in _tables:
        table = byte_table(encoder(tokenizer).lib)
        _tables[tokenizer] = table, np.array([len(t) for t in table], dtype=np.int64)
    return _tables[tokenizer]


def halves(size: int, leaf: int = LEAF) -> int:
    """Number of leaves, a power of two, for a text of this many bytes."""
    return 1 if size <= leaf else 1 << (-(-size // leaf) - 1).bit_length()


def cut(text: bytes, leaf: int = LEAF) -> list[bytes]:
    """Leaves of about equal size whose ends are code-point boundaries."""
    n = halves(len(text), leaf)
    at = [len(text) * k // n for k in range(n + 1)]
    for k in range(1, n):
        while at[k] > at[k - 1] and at[k] < len(text) and text[at[k]] & 0xC0 == 0x80:
            at[k] -= 1
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def _usable(text: bytes, at: int) -> bool:
    """Whether a scan may start here: no half code point, and no apostrophe, which could begin a contraction."""
    return at in (0, len(text)) or (text[at] & 0xC0 != 0x80 and text[at] != 0x27 and text[at - 1] != 0x27)


def join(tokenizer: str, left: bytes, a: np.ndarray, right: bytes, b: np.ndarray) -> np.ndarray:
    """Tokens of left + right from the tokens of each."""
    if not len(a) or not len(b):
        return b if not len(a) else a
    size = table_of(tokenizer)[1]
    ends_a, ends_b = np.cumsum(size[a]), np.cumsum(size[b])
    if ends_a[-1] != len(left) or ends_b[-1] != len(right):
        raise ValueError("tokens and text differ")
    lib = encoder(tokenizer)
    reach = WINDOW
    while True:
        i, j = max(0, len(a) - reach), min(len(b), reach)
        while i and not _usable(left, int(ends_a[i - 1])):
            i -= 1
        while j < len(b) and not _usable(right, int(ends_b[j - 1])):
            j += 1
        start, end = int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1])
        middle = np.frombuffer(lib.whole([left[start:] + right[:end]])[0], dtype="<u4")
        same_left = not i or np.array_equal(middle[:AGREE], a[i : i + AGREE])
        same_right = j == len(b) or np.array_equal(middle[-AGREE:], b[max(0, j - AGREE) : j])
        if same_left and same_right:
            return np.concatenate([a[:i], middle, b[j:]])
        reach *= 4


def join_all(tokenizer: str, leaves: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
    """Join neighbours level by level until one sequence is left."""
    while len(leaves) > 1:
        pairs = range(0, len(leaves), 2)
        ids = [join(tokenizer, leaves[k], ids[k], leaves[k + 1], ids[k + 1]) for k in pairs]
        leaves = [leaves[k] + leaves[k + 1] for k in pairs]
    return ids[0]


def encode_tree(text: bytes, tokenizer: str = BYTE_BPE, leaf: int = LEAF) -> np.ndarray:
    """The same in one process."""
    leaves = cut(text, leaf)
    return join_all(tokenizer, leaves, [np.frombuffer(x, dtype="<u4") for x in encoder(tokenizer).encode(leaves)])


def decode_ids(ids: np.ndarray, tokenizer: str = BYTE_BPE) -> str:
    """As the library's decode(ids, skip_special_tokens=False)."""
    return b"".join(map(table_of(tokenizer)[0].__getitem__, ids.tolist())).decode("utf-8", "replace")


def _lists(values: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) // 4 for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), dtype="<i4")))


def encode(df: DataFrame, text: str = "text", tokenizer: str = BYTE_BPE, leaf: int = LEAF) -> DataFrame:
    """df with ids array<int>; the text column is dropped."""
    rest = [c for c in df.columns if c not in (text, "ids")]
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("_text"))
    out = src.select(*rest, F.array().cast("array<int>").alias("ids")).schema
    is_long = F.octet_length("_text") > leaf

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(tokenizer)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                ids = list(lib.encode(texts_of(b.column("_text"))))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), _lists(ids)], names=[*rest, "ids"])

    short = src.where(F.col("_text").isNull() | ~is_long).mapInArrow(at_once, out)

    # one lineage: a row's number is worked out once and travels with its leaves and other columns
    numbered = src.where(is_long).withColumn("_uid", F.monotonically_increasing_id())
    carried = numbered.select("_uid", *rest).schema.fields
    leaf_schema = StructType([*carried, StructField("_n", IntegerType()), StructField("_leaf", BinaryType())])

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(texts_of(b.column("_text"))):
                leaves = cut(t, leaf)
                row = b.slice(k, 1).select(["_uid", *rest])
                many = [c.take(pa.array([0] * len(leaves))) for c in row.columns]
                yield pa.RecordBatch.from_arrays([*many, pa.array(range(len(leaves)), pa.int32()), pa.array(leaves, pa.binary())], names=["_uid", *rest, "_n", "_leaf"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(tokenizer)
        for b in batches:
            ids = list(lib.encode(b.column("_leaf").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, "_ids"])

    def join_group(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        ids = join_all(tokenizer, t.column("_leaf").to_pylist(), [np.frombuffer(x, dtype="<u4") for x in t.column("_ids").to_pylist()])
        return t.slice(0, 1).select(rest).append_column("ids", _lists([ids.astype("<u4").tobytes()]))

    joined = (
        numbered.mapInArrow(to_leaves, leaf_schema)
        .repartition(F.col("_uid"), F.col("_n"))
        .mapInArrow(encode_leaves, StructType([*leaf_schema.fields, StructField("_ids", BinaryType())]))
        .groupBy("_uid").applyInArrow(join_group, out)
    )
    return short.unionByName(joined)


def decode(df: DataFrame, ids: str = "ids", tokenizer: str = BYTE_BPE) -> DataFrame:
    """df with decoded string, the text of its ids; null ids decode to an empty text."""
    rest = [c for c in df.columns if c != "decoded"]
    out = df.select(*[F.col(f"`{c}`") for c in rest], F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(tokenizer)[0]
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                col = b.column(ids)
                values, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                found = [b"".join(map(table.__getitem__, values[s:e].tolist())).decode("utf-8", "replace") for s, e in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(found, pa.string())], names=[*rest, "decoded"])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, out)


def op1_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
