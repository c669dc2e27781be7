"""Near duplicates by the exact Jaccard similarity of word shingles (the pipeline's stage near_dedup).

Words and shingles are those of op8, at five words; a text of fewer words is one shingle. Texts of equal shingle sets are one class. Classes are nominated in two ways:

* by op8's own steps: SimHash fingerprints over these shingles, links within ``RADIUS`` bits through sharded BK-trees (``simhash.near_links``);
* where one of ``BANDS`` bands of ``ROWS`` MinHash values agrees: two sets of similarity s do with 1 - (1 - s ** ROWS) ** BANDS, 0.999997 at 0.8. That radius alone
  finds few copies of a similarity near 0.8, and 64 bits would need one of about 19 for them, which 1 in 2,000 pairs of unrelated texts are within.

Within the groups that nominations form, two classes link if the sets, of 64-bit hashes, have a similarity of ``least`` or more. Components of the links are the groups.

Defined results: null text and text without words are one class; very long texts are read whole; rows with a null id go with their class; repeated rows
stay in ``members``; an empty table gives an empty result; other columns are kept as they are by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._groups import Sets, group_links
from tessera.llm._tables import cut_lineage, map_batches
from tessera.llm._words import NOT_SPACE, grams, mix, slices, split
from tessera.llm.components import connected_components
from tessera.llm.simhash import fingerprint, near_links, smallest_rows

ROWS, BANDS = 4, 24
#: Bits in which fingerprints of nominated classes differ, at most: that of op8.
RADIUS = 4
#: Most sets, and bytes of sets, in a shard in which sets are compared, about.
SHARD, SHARD_BYTES = 512, 8 << 20
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, in order."""
    for at, to, data, bounds in slices(texts):
        words = split(data, bounds, NOT_SPACE, lower=True)
        every = words.grams(shingle)
        for i in range(to - at):
            first, last = int(words.first[i]), int(words.first[i + 1])
            if last - first >= shingle:
                yield np.unique(every[first : last - shingle + 1])
            else:
                own = words.hash[first:last]
                yield grams(own, np.zeros(len(own), np.int64), len(own))[:1] if len(own) else own


def _bands(found: np.ndarray) -> list[int]:
    """A number for each band of the set's MinHash values; none for the empty set, which is alike to nothing else."""
    if not len(found):
        return []
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        np.minimum(least, (mix(found[at : at + 4096])[:, None] * _SEEDS).min(0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in mix(least).reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + row)
    return out.view(np.int64).tolist()


def _classes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (hash of the text), cls (128 bits of the shingle set), bands and fp (SimHash) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, bands = [], []
            for found in shingle_sets(batch.column("text"), shingle):
                cls.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(_bands(found))
            fps = pa.array([fingerprint(text.as_py() or "", shingle) for text in batch.column("text")], pa.int64())
            cells = [batch.column("doc_id"), batch.column("key"), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), fps]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "key", "cls", "bands", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return rows.transform(map_batches, compute, "doc_id long, key long, cls binary, bands array<long>, fp long")


def simhash_links(classes: DataFrame) -> DataFrame:
    """(cls, low): ``classes`` (cls, fp) joined where fingerprints are within ``RADIUS`` bits."""
    fps = cut_lineage(classes.groupBy("fp").agg(F.min("cls").alias("id")))
    equal = classes.join(fps, "fp").select("cls", F.col("id").alias("low")).where("cls <> low")
    return equal.union(near_links(fps, RADIUS, fps.count()))


def _compare(members: pa.StructArray, left: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sets that link; see ``group_links``."""
    found = [np.frombuffer(x, np.uint64) for x in members.field("found").to_pylist()]
    sizes = np.array([len(x) for x in found])
    sets = Sets(len(found))
    for i in range(len(found) if left is None else left):
        near = sets.apart(i, np.arange(i + 1 if left is None else left, len(found)))
        for j in near[np.minimum(sizes[near], sizes[i]) + 1e-9 >= least * np.maximum(sizes[near], sizes[i])].tolist():
            if sets.label[i] != sets.label[j]:
                shared = len(np.intersect1d(found[i], found[j], assume_unique=True))
                if shared + 1e-9 >= least * (sizes[i] + sizes[j] - shared):
                    sets.join(i, j)
    return sets.pairs()


def members(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, key, cls and component_id (smallest doc_id of the group; null if no row of it has an id) of every row."""
    found = cut_lineage(_classes(docs, shingle))
    classes = cut_lineage(found.where("doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "key", "fp")).alias("own"), F.first("bands").alias("bands")))
    keyed = classes.select("cls", F.explode("bands").alias("_key"))
    stars = keyed.groupBy("_key").agg(F.min("cls").alias("low"), F.count("*").alias("_n")).where("_n > 1").select("_key", "low")
    banded = keyed.join(stars, "_key").select("cls", "low").where("cls <> low")
    groups = connected_components(banded.union(simhash_links(classes.select("cls", "own.fp"))).distinct())
    wanted = classes.join(groups, F.col("cls") == F.col("node")).select(F.col("own.doc_id").alias("_id"), F.col("own.key").alias("_key"), "cls", F.col("component").alias("group"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("group"), pa.array(sets, pa.binary())], ["id", "group", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    texts = rows.join(wanted.hint("shuffle_hash"), ["_id", "_key"]).select("cls", "group", "text")
    sets = cut_lineage(texts.transform(map_batches, read, "id binary, group binary, found binary").dropDuplicates(["id"]))
    links = group_links(sets, lambda members, left: _compare(members, left, least), SHARD, SHARD_BYTES, sets.select("group", F.octet_length("found").alias("size")))
    joined = classes.join(connected_components(links), F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("component"), "own.doc_id")
    named = joined.join(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("cls", "component_id")
    return found.select("doc_id", "key", "cls").join(named, "cls", "left")


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group; which one as in ``simhash.one_of_each``."""
    return smallest_rows(docs, members(docs, shingle, least).withColumnRenamed("cls", "fp"))
