"""Index files: postings in buckets by a hash of their key, a table of keys, and a manifest that is written last.

A folder holds any number of versions, ``postings-<version>`` and ``keys-<version>``, and ``manifest`` with a row for each finished one; readers take the
newest. A write that fails leaves no row there, so the version before stays what readers see.

* Postings are sorted by bucket, facet, key and id over all tasks, ids included, so a key of very many ids is dealt over tasks; a row holds at most ``block`` ids of a
  key, as the first one and the gaps between the others.
* Look-ups of given keys read the folders of their buckets alone; a search for parts of keys reads the table of keys first and then the buckets
  of those it found.

Defined results: null or empty keys and null ids are left out, and repeats count once; a facet or key that is not there has no ids; an index without rows is
one without keys; a folder without a manifest is no index (``load`` gives None).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import versions

POSTINGS = "facet string, key string, first long, last long, n int, gaps array<long>, bucket int"
MANIFEST = "version string, buckets int, block int"


def _bucket(facet: Column, key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(facet, key), F.lit(buckets)).cast("int")


def write(entries: DataFrame, path: str, buckets: int = 64, block: int = 4096) -> str:
    """Write (facet, key, id) as a new version of the index at ``path``, and return the version's name."""
    kept = entries.select(F.col("facet").cast("string"), F.col("key").cast("string"), F.col("id").cast("long")).where("facet is not null and key <> '' and id is not null")
    kept = kept.withColumn("bucket", _bucket(F.col("facet"), F.col("key"), buckets))
    order = ["bucket", "facet", "key", "id"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key's rows may go on in the next batch
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = _once(held)
            cut = _starts(held)
            whole = held.num_rows if held.num_rows >= 8 * block and len(cut) == 1 else int(cut[-1])
            whole -= whole % block if whole == held.num_rows else 0
            yield from _blocks(held.slice(0, whole), block)
            held = held.slice(whole)
        if held is not None:
            yield from _blocks(held, block)

    rows = kept.repartitionByRange(*order).sortWithinPartitions(*order).select("facet", "key", "id", "bucket").mapInArrow(runs, POSTINGS)
    version = versions.name()
    rows.write.partitionBy("bucket").parquet(f"{path}/postings-{version}")
    spark = entries.sparkSession
    written = spark.read.schema(POSTINGS).parquet(f"{path}/postings-{version}")
    keys = written.groupBy("bucket", "facet", "key").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.min("first").alias("first"), F.max("last").alias("last"))
    keys.sortWithinPartitions("facet", "key").write.parquet(f"{path}/keys-{version}")
    versions.publish(spark, path, MANIFEST, version, buckets, block)
    return version


def _once(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows without their repeats; equal rows are in one range, and so side by side in one task."""
    new = _changes(rows, ("id", "key", "facet"))
    return rows if new.all() else rows.take(pa.array(np.flatnonzero(new)))


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where another facet or key begins; 0 for the first row."""
    return np.flatnonzero(_changes(rows, ("facet", "key")))


def _changes(rows: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Whether each row differs from the one before in some of the columns; true for the first."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        column = rows.column(c)
        if rows.num_rows > 1:
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return new


def _blocks(rows: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """A row for every ``block`` ids, at most, of a key."""
    if not rows.num_rows:
        return
    start = _starts(rows)
    size = np.diff(np.append(start, rows.num_rows))
    parts = -(-size // block)
    first = np.repeat(start, parts) + block * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.append(first[1:], rows.num_rows)
    ids = rows.column("id").to_numpy()
    gaps = np.diff(ids, prepend=0)
    inner = np.ones(len(ids), bool)
    inner[first] = False  # the first id of a block stands beside its gaps
    offsets = np.append(0, np.cumsum(end - first - 1)).astype(np.int32)
    at = pa.array(first)
    cells = [rows.column("facet").take(at), rows.column("key").take(at), pa.array(ids[first]), pa.array(ids[end - 1]), pa.array((end - first).astype(np.int32))]
    yield pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array(offsets), pa.array(gaps[inner])), rows.column("bucket").take(at)], ["facet", "key", "first", "last", "n", "gaps", "bucket"])


@dataclass
class Index:
    """A version of an index."""

    spark: SparkSession
    path: str
    version: str
    buckets: int

    @property
    def keys(self) -> DataFrame:
        """(bucket, facet, key, n, blocks, first, last): every key with how many ids it has."""
        return self.spark.read.parquet(f"{self.path}/keys-{self.version}")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings-{self.version}")

    def lookup(self, wanted: Iterable[tuple[str, str]]) -> DataFrame:
        """(facet, key, id) of given facets and keys; buckets are constants of the plan, so other folders are not listed into it."""
        hit = F.lit(False)
        for facet, key in wanted:
            hit |= (F.col("bucket") == _bucket(F.lit(facet), F.lit(key), self.buckets)) & (F.col("facet") == facet) & (F.col("key") == key)
        return ids(self.blocks.where(hit))

    def ids_of(self, wanted: DataFrame) -> DataFrame:
        """(facet, key, id) of a table of facets and keys, of any size; where it is small its buckets prune the scan."""
        asked = wanted.select("facet", "key").distinct().withColumn("bucket", _bucket(F.col("facet"), F.col("key"), self.buckets))
        return ids(self.blocks.join(asked, ["bucket", "facet", "key"], "left_semi"))

    def search(self, query: str, facets: Iterable[str] | None = None) -> DataFrame:
        """Distinct ids of all keys, of the facets if given, that contain the trimmed query, ignoring case; none for an empty query."""
        wanted, own = query.strip().lower(), self.keys
        found = own.where(F.contains(F.lower("key"), F.lit(wanted))) if wanted else own.limit(0)
        found = found.where(F.col("facet").isin(list(facets))) if facets is not None else found
        return ids(self.blocks.join(F.broadcast(found.select("bucket").distinct()), "bucket", "left_semi").join(found.select("facet", "key"), ["facet", "key"], "left_semi")).select("id").distinct()


def load(spark: SparkSession, path: str) -> Index | None:
    """The newest finished version at ``path``; None if there is none."""
    newest = versions.newest(spark, path, MANIFEST)
    return newest and Index(spark, path, newest["version"], newest["buckets"])


def _unfolded(batch: pa.RecordBatch) -> np.ndarray:
    """All ids of a batch of blocks, in order."""
    n = batch.column("n").to_numpy()
    gaps = batch.column("gaps").flatten().to_numpy()
    start = np.cumsum(n) - n
    steps = np.zeros(n.sum(), np.int64)
    inner = np.ones(len(steps), bool)
    inner[start] = False
    steps[inner] = gaps
    total = np.cumsum(steps)
    return total - np.repeat(total[start], n) + np.repeat(batch.column("first").to_numpy(), n) if len(n) else total


def ids(blocks: DataFrame) -> DataFrame:
    """(facet, key, id) of blocks: the first id and the running sum of the gaps."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            found = _unfolded(batch)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("facet").take(at), batch.column("key").take(at), pa.array(found)], ["facet", "key", "id"])

    return blocks.select("facet", "key", "first", "n", "gaps").mapInArrow(unfold, "facet string, key string, id long")


def totals(blocks: DataFrame) -> DataFrame:
    """(facet, key, n, id_sum, lowest, highest) of every key: each block is unfolded and summed where it is read, and only its totals are grouped."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first = batch.column("n").to_numpy().astype(np.int64), batch.column("first").to_numpy()
            found, start = _unfolded(batch), np.cumsum(n) - n
            sums = np.add.reduceat(found, start) if len(n) else found
            highest = np.maximum.reduceat(found, start) if len(n) else found
            yield pa.RecordBatch.from_arrays([batch.column("facet"), batch.column("key"), pa.array(n), pa.array(sums), pa.array(first), pa.array(highest)], ["facet", "key", "n", "id_sum", "lowest", "highest"])

    summed = blocks.select("facet", "key", "first", "n", "gaps").mapInArrow(add, "facet string, key string, n long, id_sum long, lowest long, highest long")
    return summed.groupBy("facet", "key").agg(F.sum("n").alias("n"), F.sum("id_sum").alias("id_sum"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
