"""The contract: every query runs, and equals its SQL, on the smallest tables."""

import os

import pytest

from peakweave.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("lineitem", "part", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.ORACLE_SQL[name]}) t").fetchall()
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_entry_module_imports():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
