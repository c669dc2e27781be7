"""Queries with SQL against DuckDB on tables of odd rows that the given ones lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.plans import card_queries, catalog, index_queries, lookup_queries, record_queries  # noqa: F401  the others add their queries to the catalogue


def agrees(spark, folder, name, **tables):
    """Whether a query and its SQL give the same rows over ``tables``."""
    duck = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, str(folder))
    want = duck.sql(catalog.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(found.columns) == order
    got = sorted((tuple(r[c] for c in order) for r in found.collect()), key=str)
    return got == sorted((tuple(r) for r in want.select(*order).fetchall()), key=str) and bool(got)


def documents(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_description_validity(spark, tmp_path):
    texts = [None, "", "    ", "||||", "a    ", "     |", "##% ", "~~~~~~", "x" * 500, "x" * 501, " " * 501 + "||", "\x0b\x0b\x0b and more", "ééé and more", "á́́", "    ", "😀😀😀", "|\n|"]
    assert agrees(spark, tmp_path, "description_validity", documents=documents(texts))
