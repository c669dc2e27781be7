"""SimHash near-duplicates: fingerprints of whole texts, linked through sharded BK-trees (op8).

Equal fingerprints are one class before any comparison. Two fingerprints of at most ``radius`` differing bits agree on at
least ``blocks - radius`` of ``blocks`` bit blocks (pigeonhole), so classes meet in buckets of equal blocks; the number of blocks follows
the number of classes, which keeps buckets small and changes no result. A bucket of any size is dealt
into shards of bounded size (``_groups``); a shard's BK-tree (children keyed by their Hamming distance to the
parent) is searched for every member of the shard, and of other shards for those that no pivot settles, and a search follows only edges within the
radius. What leaves a task is a spanning forest of what it found, never the pairs.

Defined results: null text and text without words have fingerprint zero and link like any other; very long texts are read whole; rows with a null
id are fingerprinted, but their class takes its component from rows that have one (null if none has); repeated rows stay; an empty table gives an
empty result; other columns are ignored, or kept as they are by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm._groups import Sets, group_links
from tessera.llm._tables import cut_lineage, fresh, map_batches
from tessera.llm._words import LOWER
from tessera.llm.components import connected_components

_LOWER = LOWER.tobytes()
#: Most fingerprints in a tree, about; a bucket of more is dealt into several.
SHARD = 1024
#: Fingerprints that a bucket is meant to hold on average.
BUCKET = 64


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64 bits; one is set if over half of the shingles' XXH64 values have it. No words: 0."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words)), initial=0))
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        hashes = np.fromiter((xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(ends[at:to], ends[min(shingle, len(words)) + at :], strict=False)), np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, a hash of the text (``key``) and the fingerprint (``fp``, a long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").transform(map_batches, compute, "doc_id long, key long, fp long")


class BKTree:
    """Fingerprints as nodes; a node's children are keyed by their distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        items = values.tolist()
        for i in range(1, len(items)):
            at = 0
            while True:
                d = (items[i] ^ items[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    break
                at = below

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions in ``queries`` within the radius of it); all queries walk the tree together."""
        waiting = [(0, np.arange(len(queries)))] if len(self.values) else []
        while waiting:
            node, own = waiting.pop()
            d = np.bitwise_count(queries[own] ^ self.values[node]).astype(np.int16)
            near = own[d <= radius]
            if len(near):
                yield node, near
            for key, child in self.children[node].items():
                on = own[np.abs(d - key) <= radius]
                if len(on):
                    waiting.append((child, on))


def _spanning(members: pa.StructArray, left: int | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of fingerprints to link, a forest: of all within the radius, or only of those between the first ``left`` and the others."""
    values = members.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
    tree = BKTree(values if left is None else values[:left])
    asked = values if left is None else values[left:]
    sets = Sets(len(values))
    for node, near in tree.search(asked, radius):
        for j in sets.apart(node, near + (left or 0)).tolist():
            sets.join(node, j)
    return sets.pairs()


def bucketed(classes: DataFrame, radius: int, count: int, bucket: int = BUCKET) -> DataFrame:
    """(group, id, fp): ``classes`` (fp, id) in each bucket of equal blocks that any two within ``radius`` bits share one of.

    ``count`` says how many classes there are; buckets are made to hold about ``bucket`` of them.
    """
    blocks = radius + 1
    while count >> (64 * (blocks - radius) // blocks) > bucket and blocks < 2 * radius:
        blocks += 1
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    # one number names table and block values; should two blocks share it, their bucket only grows
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    return classes.select(F.explode(keys).alias("group"), "id", "fp")


def near_links(classes: DataFrame, radius: int, count: int, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between ids of fingerprint classes (fp, id) that join every two within ``radius`` bits; a shard's tree holds about ``shard``."""
    return group_links(bucketed(classes, radius, count, bucket), lambda members, left: _spanning(members, left, radius), shard)


def _members(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    found = cut_lineage(fingerprints(docs, shingle))
    classes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"))
    groups = connected_components(near_links(classes, radius, classes.count()))
    members = classes.join(groups, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return found.join(members, "fp", "left")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable over links)."""
    return _members(docs, radius, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def smallest_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of each group of ``members`` (doc_id, key, fp, component_id): see ``one_of_each``."""
    no_id = F.lit(-(1 << 63))
    own, text = fresh(docs.columns, "__id", "__key")
    members = members.where("component_id is null or doc_id = component_id")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.hex("fp")))
    kept = members.groupBy(group.alias("_group")).agg(F.coalesce(F.min("doc_id"), no_id).alias(own), F.min("key").alias(text)).drop("_group")
    # a row without an id and a row with the smallest long would meet here; no such id is handed out
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), no_id), text: F.xxhash64("text")})
    return keyed.join(kept.hint("shuffle_hash"), [own, text], "left_semi").dropDuplicates([own, text]).drop(own, text)


def one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each group: of the smallest id and, of rows with that id, the smallest hash of the text.

    Rows without an id stay only if no row with an id is in their group; then one of each fingerprint does.
    """
    return smallest_rows(docs, _members(docs, radius, shingle))
