"""Every registered query against its SQL form, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    rel = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = ordered([tuple(r) for r in df.collect()])
    at = [list(rel.columns).index(c) for c in df.columns]
    want = ordered([tuple(r[i] for i in at) for r in rel.fetchall()])
    assert got == want


def test_registry_is_consistent(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() == 125


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql())))
def test_other_queries_run(spark, name):
    assert entry_module.queries()[name](spark, SF).count() > 0
