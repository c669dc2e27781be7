"""Changes merged into nested records, and versions of a table of them."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.upsert import upsert
from tessera.sources import versions

OLD = "id long, name string, place struct<city:string,at:struct<lat:double,lon:double>>, tags array<string>, links map<string,string>, n int"
NEW = "id long, place struct<AT:struct<lat:double,alt:double>,zip:string>, tags array<string>, links map<string,string>, name string, extra boolean"


def test_merge_goes_down_the_schema(spark):
    old = spark.createDataFrame([(1, "a", ("x", (1.0, 2.0)), ["t"], {"k": "v", "m": "w"}, 5), (2, "b", None, None, None, None), (3, "c", ("y", None), [], {}, 1), (None, "nobody", None, None, None, 0)], OLD)
    new = spark.createDataFrame([(1, ((None, 9.0), "z"), [], {"k": "new", "m": "", "q": "r"}, "", True), (2, ((3.0, None), None), ["u"], {"a": "b"}, "bb", None), (4, None, None, None, "d", False), (None, None, None, None, "lost", None)], NEW)
    got = {r.id: r.asDict(recursive=True) for r in upsert(old, new, "id").collect()}
    at = lambda lat, lon, alt: {"lat": lat, "lon": lon, "alt": alt}
    assert got[1] == {"id": 1, "name": "a", "place": {"city": "x", "at": at(1.0, 2.0, 9.0), "zip": "z"}, "tags": ["t"], "links": {"k": "new", "m": "w", "q": "r"}, "n": 5, "extra": True}
    assert got[2] == {"id": 2, "name": "bb", "place": {"city": None, "at": at(3.0, None, None), "zip": None}, "tags": ["u"], "links": {"a": "b"}, "n": None, "extra": None}
    assert got[3] == {"id": 3, "name": "c", "place": {"city": "y", "at": None, "zip": None}, "tags": [], "links": {}, "n": 1, "extra": None}
    assert got[4] == {"id": 4, "name": "d", "place": None, "tags": None, "links": None, "n": None, "extra": False}
    assert got[None]["name"] == "nobody" and len(got) == 5


def test_last_change_counts(spark):
    old = spark.createDataFrame([(1, "a")], "id long, name string")
    new = spark.createDataFrame([(1, "x", 1), (1, "z", 3), (1, "y", 2), (2, "n", 1)], "id long, name string, turn int")
    assert sorted(map(tuple, upsert(old, new, "id", "turn").collect())) == [(1, "z"), (2, "n")]


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path)
    assert versions.read(spark, path) is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    versions.write_changes(rows, path, "id")
    held = versions.read(spark, path)
    with pytest.raises(Exception, match="broken"):
        versions.write_changes(rows.withColumn("name", F.raise_error(F.lit("broken")).cast("string")), path, "id")
    assert sorted(map(tuple, versions.read(spark, path).collect())) == [(1, "a"), (2, "b")]
    versions.write_changes(spark.createDataFrame([(2, "c"), (3, "d")], "id long, name string"), path, "id")
    assert sorted(map(tuple, versions.read(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, held.collect())) == [(1, "a"), (2, "b")]  # readers of the version before are not disturbed
