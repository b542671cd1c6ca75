import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import running
from sparkloom.plans.registry import QUERIES, SQL


def by_tree(values, a, b):
    """The sum of rows a to b of a tree of 16 children a node: parts to the left from below, then to the right from above."""
    if a // 16 == b // 16:
        parts = values[a:b]
    else:
        left = values[a : -(-a // 16) * 16]
        nodes = [by_tree_node(values[k : k + 16]) for k in range(0, len(values) // 16 * 16, 16)]
        return by_tree_from(nodes, -(-a // 16), b // 16, by_tree_node(left), values[b // 16 * 16 : b])
    return by_tree_node(parts)


def by_tree_node(values, total=0.0):
    for x in values:
        total += x
    return total


def by_tree_from(nodes, a, b, total, right):
    if a // 16 == b // 16:
        return by_tree_node(right, by_tree_node(nodes[a:b], total))
    up = -(-a // 16)
    total = by_tree_node(nodes[a : up * 16], total)
    above = [by_tree_node(nodes[k : k + 16]) for k in range(0, len(nodes) // 16 * 16, 16)]
    return by_tree_node(right, by_tree_from(above, up, b // 16, total, nodes[b // 16 * 16 : b]))


@pytest.mark.parametrize("start", [0, 5, 16, 250, 256])
def test_tree_sum(start):
    rng = random.Random(start)
    values = [0.0] * start + [round(rng.expovariate(0.02), 2) for _ in range(700)]
    tree = running.TreeSum(start)
    assert [tree.add(x) for x in values[start:]] == [by_tree(values, start, b) for b in range(start + 1, len(values) + 1)]


def test_hashes(spark):
    keys = [0, 1, -1, 7, 2**62, -(2**63), None]
    want = [duckdb.execute("SELECT hash(?::BIGINT)", [k]).fetchone()[0] >> 40 & 255 for k in keys]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k long").coalesce(1)
    assert [r.h for r in df.select("i", running._dealt(F.col("k")).alias("h")).orderBy("i").collect()] == want


@pytest.mark.parametrize("nulls", [False, True])
def test_budget_gate_where_sums_meet_the_limit(spark, tmp_path, nulls):
    # multiples of 0.8, so that every few users have spent 1000 exactly
    rng = random.Random(9)
    gone = lambda x, share: None if nulls and rng.random() < share else x
    rows = [(i, gone(i, 0.01), gone(rng.randrange(300), 0.02), gone(round(0.8 * rng.randrange(60), 2), 0.02)) for i in range(20000)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double")
    e.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "'view' AS event_type", "value", "'{}' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(r[0] for r in con.execute(SQL["budget_gate"]).fetchall())
    assert sorted(r.event_id for r in QUERIES["budget_gate"](spark, str(tmp_path)).collect()) == want


def test_ordered_means(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(20), i, None if rng.random() < 0.05 else rng.random()) for i in range(2000)] + [(20, 2000, None)]
    df = spark.createDataFrame(rows, "k long, i long, x double").repartition(7)
    got = {r.k: r.mean for r in running.ordered_means(df, ["k"], ["i"], "x").collect()}
    want = {}
    for k in range(21):
        x = [v for q, _, v in rows if q == k and v is not None]
        want[k] = by_tree_node(x) / len(x) if x else None
    assert got == want


def test_duels_whose_difference_meets_the_limit(spark, tmp_path):
    # sums in cents, of which every user's differ by 25.00 a row in the mean: the limit of 0.05
    rng = random.Random(6)
    rows = []
    for user in range(800):
        n, sign = rng.randrange(4, 14), rng.choice([-1, 1])
        views, clicks = [[rng.randrange(8000, 12000) for _ in range(n)] for _ in range(2)]
        clicks[0] += sum(views) + sign * 2500 * n - sum(clicks)
        rows += [(user, kind, c / 100) for kind, cents in (("view", views), ("click", clicks)) for c in cents if min(clicks) >= 0]
    rng.shuffle(rows)
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    e.selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "value", "'{}' AS props").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["duel_summary"]).fetchall()
    got = QUERIES["duel_summary"](spark, str(tmp_path)).collect()
    assert [(r.policy, r.n, r.wins, r.ties, r.losses) for r in got] == [(r[0], r[1], *r[3:]) for r in want]
    assert abs(got[0].mean_delta - want[0][2]) < 1e-12 and min(want[0][3:]) > 10
