import os

import duckdb
import pytest

from sparkloom.plans import evaluation, trajectories  # noqa: F401 (they add to the registry)
from sparkloom.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    found = QUERIES[name](spark, FOLDER)
    names = sorted(found.columns)
    asked = con.execute(SQL[name])
    order = [d[0] for d in asked.description]
    assert sorted(order) == names
    want = sorted(tuple(plain(r[order.index(n)]) for n in names) for r in asked.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in found.collect()) == want
