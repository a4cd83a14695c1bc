"""Every query that has SQL, against DuckDB on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quirefold.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(found):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    rows = got.select(*order).collect()
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == order
        assert comparable(rows) == comparable(want.select(*[f'"{c}"' for c in order]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
