"""Index files: blocks, versions and what a look-up reads."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import index_files


def entries(spark, n=3000):
    r = random.Random(2)
    rows = [("a", f"k{r.randrange(40)}", r.randrange(-50, 10**12)) for _ in range(n)] + [("b", "hot", i * 3) for i in range(n)] + [("a", "hot", 7)]
    return rows + rows[:20], spark.createDataFrame(rows + rows[:20] + [("a", "", 1), ("a", None, 1), (None, "x", 1), ("a", "y", None)], "facet string, key string, id long").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_every_id_comes_back(spark, tmp_path, block):
    rows, df = entries(spark)
    index_files.write(df, str(tmp_path), buckets=8, block=block)
    index = index_files.load(spark, str(tmp_path))
    assert sorted(map(tuple, index_files.ids(index.blocks).collect())) == sorted(set(rows))
    assert index.blocks.agg(F.max("n")).first()[0] <= block
    keys = {(r.facet, r.key): (r.n, r.blocks) for r in index.keys.collect()}
    assert keys["b", "hot"][0] == 3000 and keys["a", "hot"][0] == 1 and keys["b", "hot"][1] >= 3000 // block


def test_lookups_read_their_buckets_alone(spark, tmp_path):
    rows, df = entries(spark)
    index_files.write(df, str(tmp_path), buckets=16)
    index = index_files.load(spark, str(tmp_path))
    wanted = [("b", "hot"), ("a", "k3"), ("a", "nowhere")]
    found = index.lookup(wanted)
    assert sorted(map(tuple, found.collect())) == sorted(x for x in set(rows) if x[:2] in wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # files of other buckets may be broken
    needed = {r.bucket for r in index.keys.where(F.struct("facet", "key").isin([F.struct(F.lit(f), F.lit(k)) for f, k in wanted])).collect()}
    others = [p for p in tmp_path.glob("postings-*/bucket=*/*.parquet") if int(p.parent.name.split("=")[1]) not in needed]
    assert others
    before = {p: p.read_bytes() for p in others}
    for p in others:
        p.write_bytes(b"broken")
        p.with_name(f".{p.name}.crc").unlink()
    assert sorted(map(tuple, index.lookup(wanted[:2]).collect())) == sorted(x for x in set(rows) if x[:2] in wanted[:2])
    for p, data in before.items():
        p.write_bytes(data)
    table = spark.createDataFrame([*wanted, wanted[0]], "facet string, key string")
    assert sorted(map(tuple, index.ids_of(table).collect())) == sorted(x for x in set(rows) if x[:2] in wanted)
    assert {r.id for r in index.search(" K3").collect()} == {i for _, k, i in rows if "k3" in k}
    assert {r.id for r in index.search("hot", ["a"]).collect()} == {7} and not index.search("  ").collect()


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    assert index_files.load(spark, str(tmp_path / "none")) is None
    rows = spark.createDataFrame([("a", "x", 1)], "facet string, key string, id long")
    first = index_files.write(rows, str(tmp_path))
    with pytest.raises(Exception, match="no such id"):
        index_files.write(rows.withColumn("id", F.raise_error(F.lit("no such id"))), str(tmp_path))
    assert index_files.load(spark, str(tmp_path)).version == first
    index_files.write(rows.withColumn("id", F.col("id") + 1), str(tmp_path))
    assert [r.id for r in index_files.load(spark, str(tmp_path)).search("x").collect()] == [2]
    index_files.write(rows.limit(0), str(tmp_path))
    assert index_files.load(spark, str(tmp_path)).search("x").collect() == []


def test_totals_and_repeats(spark, tmp_path):
    rows = [("f", "a", i) for i in range(100)] * 3 + [("f", "b", -5), ("f", "b", 7), ("f", "b", 7), ("g", "a", 1), (None, "a", 1), ("f", "", 1), ("f", None, 1), ("f", "a", None)]
    entries = spark.createDataFrame(rows, "facet string, key string, id long").repartition(5)
    index_files.write(entries, str(tmp_path / "index"), block=8)
    found = index_files.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, index_files.totals(found.blocks).collect())) == [("f", "a", 100, 4950, 0, 99), ("f", "b", 2, 2, -5, 7), ("g", "a", 1, 1, 1, 1)]
    assert found.blocks.where("n > 8").count() == 0
    assert sorted((r["facet"], r["key"], r["n"]) for r in found.keys.collect()) == [("f", "a", 100), ("f", "b", 2), ("g", "a", 1)]


def test_words_meet_once_on_their_way(spark, sf_dir):
    from tessera.plans import index_queries

    plan = index_queries.index_words(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "id_sum" in plan.split("MapInArrow")[1]  # blocks are summed where they are read
