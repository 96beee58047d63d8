"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, key):
    got = registry.queries()[key](spark, SF)
    want = db.sql(registry.oracle_sql()[key])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("key", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, key):
    assert registry.queries()[key](spark, SF).count() > 0
