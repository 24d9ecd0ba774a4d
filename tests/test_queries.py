"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(tuple(r[i] for i in at) for r in want.fetchall())


def test_topk_is_not_a_full_sort(spark):
    plan = catalog.QUERIES["keyword_rank"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
