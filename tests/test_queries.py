"""Every registered query against its SQL, at the smallest size."""

import duckdb
import pytest

from trailspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, sf_dir, duck):
    found = plans.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    sql = plans.oracle_sql().get(name)
    if sql:
        expected = duck.sql(sql)
        assert sorted(expected.columns) == columns
        at = [expected.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
