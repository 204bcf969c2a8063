"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from folioworks.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows: pd.DataFrame) -> list[tuple]:
    def one(x) -> str:
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, (bool, str)) or type(x).__name__ == "bool":
            return str(x)
        if isinstance(x, pd.Timestamp) or hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return repr(round(float(x), 7))

    return sorted(tuple(map(one, r)) for r in rows[sorted(rows.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = duck().execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_runs(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
