"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

from tessera.plans import card_queries, catalog, index_queries, lookup_queries, record_queries  # noqa: F401  the others add their queries to the catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got  # nothing compared with nothing says nothing
    if name not in catalog.ORACLE_SQL:
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
