"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from marlspike.plans import queries as own

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(own.REGISTRY))
def test_query(spark, db, name):
    df = own.queries()[name](spark, SF)
    got = df.collect()
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(got, df.columns) == canonical(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["domain", "entity_type", "name", "depth"]
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
