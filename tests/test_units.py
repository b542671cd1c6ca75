import hashlib
import itertools
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import coerce
from sparkloom.operators.components import components
from sparkloom.operators.groups import batched, batches, boundaries
from sparkloom.sources.tables import json_lines
from sparkloom.streaming.upsert import run


def test_states(spark):
    df = spark.createDataFrame([("Resolved",), ("-1",), ("0",), ("2",), ("maybe",), (None,), ("pass",), ("",)], "v string")
    got = [tuple(r) for r in df.select(coerce.tri_state(F.col("v")), coerce.lenient_tri_state(F.col("v"))).collect()]
    assert got == [(True, True), (False, None), (False, False), (None, None), (None, None), (None, None), (None, True), (None, False)]
    numbers = spark.createDataFrame([(2.0, True), (0.0, False), (-1.0, None)], "n double, b boolean")
    got = [tuple(r) for r in numbers.select(coerce.tri_state(F.col("n"), "double"), coerce.lenient_tri_state(F.col("b"), "boolean")).collect()]
    assert got == [(True, True), (False, False), (False, None)]


def test_coercions(spark):
    r = spark.range(1).select(
        coerce.safe_number(F.lit("1.5"), "string"), coerce.safe_number(F.lit("x"), "string"), coerce.safe_number(F.lit(True), "boolean"), coerce.safe_number(F.lit("7.9"), "string", "long"),
        coerce.source_of(F.lit("s/x/data/t.parquet:3:7")), coerce.source_of(F.lit("s:3:7")), coerce.first_filled(F.lit(None).cast("string"), F.lit(" "), F.lit("b")),
        coerce.slug(F.lit(" A b/C_d. ")), coerce.roman(F.lit(1994)), coerce.roman(F.lit(0)), coerce.revision(F.lit("hub/m@v1")), coerce.revision(F.lit("hub/m")),
        coerce.canonical_json(b=F.lit("é"), a=F.lit(None).cast("int")), coerce.stamp(F.lit("2026-01-02 03:04:05").cast("timestamp"))).first()
    assert tuple(r) == (1.5, None, None, 7, "s/x", "s", "b", "a-b-c_d.", "MCMXCIV", None, "v1", None, '{"a":null,"b":"é"}', "20260102T030405Z")


def test_sample_ids(spark):
    df = spark.createDataFrame([("s/data/t.parquet:3:7",), ("s/data/t.parquet:3:7#r2",), ("bad",)], "v string")
    p = coerce.sample_id(F.col("v"))
    got = [tuple(r) for r in df.select(p["shard"], p["row"], p["turn"], p["replica"]).collect()]
    assert got == [("s/data/t.parquet", 3, 7, 1), ("s/data/t.parquet", 3, 7, 2), (None, None, None, 1)]


def test_hashes(spark):
    r = spark.range(1).select(coerce.digest(F.lit("a"), F.lit("b")).alias("d"), coerce.unit_hash(F.lit("k")).alias("u"), coerce.hash_mod(F.lit("k"), 1000).alias("m")).first()
    h = hashlib.sha256(b"k").hexdigest()
    assert r.d == hashlib.sha256(b"a\0b").hexdigest() and r.u == int(h[:16], 16) / 2**64 and r.m == int(h[:8], 16) % 1000


def test_success(spark):
    df = spark.createDataFrame([(True, False), (None, False), (None, None)], "a boolean, b boolean")
    assert [r[0] for r in df.select(coerce.success(F.col("a"), F.col("b"))).collect()] == [True, False, None]


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("x", "x")], "a string, b string")
    assert {tuple(r) for r in components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_boundaries():
    assert boundaries(list("iieet"), 2) == [2, 5]
    assert boundaries(list("abc"), 2) == [1, 3]
    assert boundaries(list("aaba"), 2) == [2, 4]


def test_boundaries_of_all_short_texts():
    """Against every split."""
    def cost(x, s, e, target):
        part = x[s:e]
        return 100 * (len(part) - max(part.count(c) for c in part)) + (8 if s and x[s - 1] == x[s] else 0) + (len(part) - target) ** 2

    for n in range(1, 7):
        for x in itertools.product("abc", repeat=n):
            for k in range(1, min(n, 3) + 1):
                splits = [(*c, n) for c in itertools.combinations(range(1, n), k - 1)]
                each = {c: sum(cost(x, s, e, n / k) for s, e in zip((0, *c), c, strict=False)) for c in splits}
                least = min(each.values())
                # of equal splits the last start is the least, then the one before it
                want = min((c for c in splits if each[c] <= least + 1e-9), key=lambda c: c[:-1][::-1])
                assert boundaries(list(x), k) == list(want), (x, k)


def test_batches(spark):
    items = [(100, 10), (90, 10), (50, 60), (40, 5), (10, 1)]
    assert batches(items, 200, 70) == [[0, 1], [2, 3, 4]]
    assert batches([(10, 1)] * 5, 30, 99) == [[0, 1, 2], [3, 4]] and batches([(500, 9), (1, 9)], 30, 5) == [[0], [1]] and batches([], 1, 1) == []
    df = spark.createDataFrame([(s, i, n, t) for s in (1, 2) for i, (n, t) in enumerate(items)], "step int, i int, n int, t int")
    got = {(r.step, r.i): r.batch for r in batched(df, ["step"], "n", "t", "i", 200, 70).collect()}
    assert got == {(s, i): b for s in (1, 2) for i, b in enumerate((0, 0, 1, 1, 1))}


def test_json_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    s = T.StructType([T.StructField("a", T.LongType())])
    assert [r.a for r in json_lines(spark, str(tmp_path), s, "tolerant").collect()] == [1, 2]
    assert json_lines(spark, str(tmp_path), s, "audit").count() == 3


def test_upsert_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.LongType()), T.StructField("v", T.LongType())])
    src = tmp_path / "in"
    src.mkdir()
    for n, rows in enumerate([[("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)]]):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip("ktv", r, strict=True))) for r in rows))
        run(spark, str(src), schema, str(tmp_path / "out"), ["k"], ["t"], str(tmp_path / "ck"))
    assert {tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / "version=1")).collect()} == {("a", 2, 3), ("b", 1, 2)}


def test_contamination_inside_lines(spark, tmp_path):
    from sparkloom.plans.registry import QUERIES

    docs = [(1, "so One two\n three  four five six it goes"), (2, "one two three four five sixty"), (3, "aha"), (4, "ahas"), (5, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, "aha"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in QUERIES["contamination_passages"](spark, str(tmp_path)).collect()} == {(1, 1), (3, 1)}


def test_upsert_of_one_sided_users(spark, tmp_path):
    from sparkloom.plans.registry import QUERIES

    rows = [(1, 1, 1, "click", 5.0), (2, 2, 1, "click", 6.0), (4, 1, 2, "view", 7.0), (7, 3, 3, "click", 8.0), (8, 1, 3, "view", 9.0), (10, 1, 4, "error", 1.0)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    e.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["full_outer_upsert_all"](spark, str(tmp_path)).select("user_id", "generated", "scored", "source").collect()}
    assert got == {(1, 6.0, None, 6.0), (2, None, 7.0, 7.0), (3, 8.0, 9.0, 8.0)}
