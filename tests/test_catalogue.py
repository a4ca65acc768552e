"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from brindle.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
    assert mine == theirs
