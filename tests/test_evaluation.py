import random
from itertools import product

from pyspark.sql import functions as F

from sparkloom.functions import shell
from sparkloom.functions.text import aligned
from sparkloom.operators.claims import claim_flags, unsupported_claims
from sparkloom.operators.prefixes import match_prefixes
from sparkloom.operators.resampling import bootstrap, poisson


COMMANDS = [("cat a.py", True), ("cd src && /usr/bin/grep -n 'a b' x | head", True), ("git diff HEAD", True), ("git log", False), ("cd src", False), ("cat a || ls", False), ("cat a &", False), ("cat a; ls", False), ("cat $(ls)", False), ("cat 'a", False), ("| cat a", False), ("cat a |", False), ("cat a && && cat b", False), ("python x.py | head", False), ("''", False), ("", False), ("  ", False), (None, False)]


def test_reads_only(spark):
    df = spark.createDataFrame(COMMANDS, "command string, want boolean")
    assert [r.command for r in df.where(shell.reads_only(F.col("command")) != F.col("want")).collect()] == []


def distances(raw, spanned):
    """Least number of white-space characters to leave out of raw and of each prefix of spanned so that the two are equal."""
    far = 99
    row = [j if not spanned[:j].strip() else far for j in range(len(spanned) + 1)]
    for x in raw:
        new = [row[0] + 1 if x.isspace() else far]
        for j, y in enumerate(spanned):
            new.append(min(row[j] if x == y else far, row[j + 1] + 1 if x.isspace() else far, new[j] + 1 if y.isspace() else far))
        row = new
    return row


def test_aligned():
    assert aligned("a  b", "a b c") == "a b" and aligned("ab", "a \n\t b") == "a \n\t b" and aligned("ab", "a     b") is None
    assert aligned("ab", "ac") is None and aligned("", " x") == "" and aligned(None, "a") is None and aligned("a", None) is None
    texts = ["".join(t) for n in range(5) for t in product("a \n", repeat=n)]
    rng = random.Random(5)
    found = 0
    for _ in range(5000):
        raw, spanned, most = rng.choice(texts), rng.choice(texts) + rng.choice(["", "b", " "]), rng.choice([0, 1, 4])
        got, least = aligned(raw, spanned, most), distances(raw, spanned)
        if got is None:
            # pairing is in order, which may count a little more than the least
            assert min(least) > 0 or raw.split() != spanned.split(), (raw, spanned)
        else:
            found += 1
            assert spanned.startswith(got) and least[len(got)] <= most, (raw, spanned, most)
        if min(least) > most:
            assert got is None
    assert found > 1000


def test_claims(spark):
    rows = [("k", 1, "The bug is fixed. All tests pass!", False, False, False), ("k", 2, "I've applied it", True, False, False), ("k", 3, "The task is complete", False, False, False), ("k", 4, "The task is done\nready to submit", False, False, True), ("n", 1, None, None, None, None)]
    turns = spark.createDataFrame(rows, "key string, turn int, prose string, edited boolean, tested boolean, diffed boolean")
    got = [(r.turn, r.reason.split()[0], r.text, r.ordinal) for r in unsupported_claims(turns, ["key"]).orderBy("ordinal").collect()]
    assert got == [(1, "fix", "The bug is fixed.", 1), (1, "test-pass", "All tests pass!", 2), (3, "completion", "The task is complete", 3)]
    flags = {r.key: (r.flagged, r.n_claims, r.evidence and len(r.evidence)) for r in claim_flags(turns, ["key"], most=2).collect()}
    assert flags == {"k": (True, 3, 2), "n": (False, 0, None)}
    assert unsupported_claims(turns.limit(0), ["key"]).count() == 0


def test_prefixes(spark):
    wanted = spark.createDataFrame([("b", 1, ["x", "y"]), ("b", 9, ["x"]), ("b", 8, ["q"]), ("c", 1, ["x"]), ("b", 7, []), ("b", 6, None), (None, 5, ["x"])], "base string, run int, prefix array<string>")
    held = spark.createDataFrame([("b", 1, 5, ["x", "y", "z"]), ("b", 2, 1, ["x", "y"]), ("b", 3, 1, ["x"]), ("b", 4, 0, ["xy"])], "base string, run int, replica int, turns array<string>")
    got = {(r.base, r.run): (r.matched_run, r.matched_replica) for r in match_prefixes(wanted, held).collect()}
    no = (None, None)
    assert got == {("b", 1): (1, 5), ("b", 9): (2, 1), ("b", 8): no, ("c", 1): no, ("b", 7): no, ("b", 6): no, (None, 5): no}


def test_bootstrap(spark):
    rng = random.Random(3)
    values = [rng.gauss(1, 2) for _ in range(400)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("a", 999, None), ("one", 1, 4.0)], "g string, k int, v double")
    got = {r.g: (r.low, r.high) for r in bootstrap(df, "g", "k", "v").collect()}
    mean = sum(values) / 400
    half = 1.96 * (sum((v - mean) ** 2 for v in values) / 400) ** 0.5 / 20
    assert abs(got["a"][0] - (mean - half)) < 0.05 and abs(got["a"][1] - (mean + half)) < 0.05
    assert got["one"] == (4.0, 4.0)


def test_poisson(spark):
    n = 1 << 12
    r = spark.range(n).select(poisson(F.col("id") * (2**32 // n) + 2**31 // n).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(r.m - 1) < 0.01 and abs(r.v - 1) < 0.02


def test_every_user_is_asked(spark, tmp_path):
    from sparkloom.plans import evaluation  # noqa: F401 (adds to the registry)
    from sparkloom.plans.registry import QUERIES

    rows = [(4 * u + k, u, kind) for u, kinds in ((2, "ab"), (3, "abc"), (6, "b"), (12, "abd")) for k, kind in enumerate(kinds)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    e.selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.run, r.n_turns, r.matched_run) for r in QUERIES["prefix_match_all"](spark, str(tmp_path)).collect()}
    assert got == {(2, 2, 2), (3, 3, 3), (6, 1, 6), (12, 2, 12)}
