"""Removal of long word sequences that an earlier document has too, by de Bruijn compaction (op5).

The graph's nodes are word k-mers, its edges lead to the next k-mer of a text. Of all k-mers, five times the input, only those are shuffled that are
the minimum of some window of ``window`` words: such a k-mer and the windows that have it form one arc, told by the k-mer and
by a hash of the words it spans, and consecutive windows of a text lead from arc to arc. Arcs whose k-mer only one document has drop out first.
A k-mer with several arcs, its least and greatest hash unlike, branches. Of the others, edges from arc to next arc are counted, in- and out-degrees are
taken from the counts, and paths on which every occurrence goes the same way are contracted to their first arc in joins that double their
reach each round. Then each document's text is read at the source coordinates of its paths, and at every window of its branching arcs,
and 128 bits of the words found there decide, BLAKE2b digests of whole paths and two independent hashes of windows: the smallest document with the
same words keeps them. At last overlapping spans are merged and the words dropped.

Defined results: null and empty texts have no words; a repeat inside one document stays; rows with one id never
remove from each other; a row with a null id (as which the smallest long counts) is no source and loses nothing; rows equal in id and text are one
document; very long texts and words are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage, map_batches, small_side, with_lists
from tessera.llm._words import NOT_SPACE, Words, digests, grams, mix, slices, spaced, split, window_minimum, word_hashes

_NO_ID = -(1 << 63)
_ARC = "kmer long, a long, _id long, _text long, start int, n int"


def _span_digests(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b digests of the words from each start to the word before each end, one space between them."""
    joined, at, _ = spaced(words, np.arange(len(words.start)), np.arange(1, len(words.start) + 1))
    behind = at + (words.end - words.start)
    return digests(joined, at[start], behind[end - 1])


def _span_names(words: Words, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words from each start to each end, out of hashes of ``window`` words, the last of which may overlap."""
    pieces = grams(mix(words.hash ^ np.uint64(0x13198A2E03707344)), words.row, window)
    out = mix((end - start).astype(np.uint64))
    for k in range(-(-int((end - start).max(initial=0)) // window)):
        out = mix((out ^ pieces[np.minimum(start + k * window, end - window)]) * np.uint64(0xD6E8FEB86659FD93))
    return out.view(np.int64)


def _arcs(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hash, first window, windows, row) of each arc."""
    empty = np.zeros(0, np.int64)
    n = len(words.hash) - window + 1
    if n < 1:
        return empty.view(np.uint64), empty, empty, empty
    kmers = words.grams(k)
    # upper half: hash; lower half: place, so that the leftmost of equal minima is taken
    ranked = (kmers & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(kmers), dtype=np.uint64)
    at = (window_minimum(ranked, window - k + 1)[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = words.row[:n] == words.row[window - 1 :]
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return empty.view(np.uint64), empty, empty, empty
    count = np.add.reduceat(whole, first, dtype=np.int64)
    return kmers[at[first]], first, count, words.row[first]


def arcs(rows: DataFrame, window: int, k: int) -> DataFrame:
    """The arcs of every row of (_id, _text, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_text"))
            for a, _, data, bounds in slices(batch.column("text")):
                words = split(data, bounds, NOT_SPACE)
                kmer, first, count, row = _arcs(words, window, k)
                if len(first):
                    span = _span_names(words, first, first + count + window - 1, window)
                    place = [ids[a + row], keys[a + row], (first - words.first[row]).astype(np.int32), count.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kmer.view(np.int64), span, *place)], ["kmer", "a", "_id", "_text", "start", "n"])

    return rows.where(F.col("_id") != _NO_ID).select("_id", "_text", "text").transform(map_batches, scan, _ARC)


def contracted(links: DataFrame) -> DataFrame:
    """(node, head, offset) of every node with a predecessor: where its path begins, and the windows before it there.

    ``links`` (u, v, n): each u and each v once, without cycles; n are the windows of u. A round sends each node that is not yet at its
    path's beginning to where the node it has reached is, so that reaches double; such nodes have all reached different ones.
    """
    state = links.select(F.col("v").alias("node"), F.col("u").alias("head"), F.col("n").cast("long").alias("offset"))
    state = cut_lineage(state.join(state.select(F.col("node").alias("head"), F.lit(False).alias("ended")), "head", "left").withColumn("ended", F.coalesce("ended", F.lit(True))).select("node", "head", "offset", "ended"))
    while not (active := state.where("not ended")).isEmpty():
        reached = state.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("offset").alias("_offset"), F.col("ended").alias("_ended"))
        moved = active.join(reached, "head").select("node", F.col("_head").alias("head"), (F.col("offset") + F.col("_offset")).alias("offset"), F.col("_ended").alias("ended"))
        state = cut_lineage(state.where("ended").union(moved))
    return state.drop("ended")


def _paths(lists: DataFrame) -> DataFrame:
    """(_id, _text, start, n) of each occurrence of each contracted path; ``lists`` has each document's repeated arcs in order."""
    whole = F.filter("arcs", lambda x: ~x["branches"])
    # an arc leads to the one that starts where its windows end; null where the next is branching, elsewhere or none
    pairs = F.zip_with(whole, F.slice(whole, 2, F.size(whole)), lambda x, y: F.struct(x.alias("x"), F.when(y["start"] == x["start"] + x["n"], y).alias("y")))
    exploded = lists.where(F.size(whole) > 0).select("_id", "_text", F.explode(pairs).alias("p")).where("p.x is not null")
    # an arc that does not branch is the only one of its k-mer
    steps = exploded.select("_id", "_text", F.col("p.x.kmer").alias("u"), F.col("p.y.kmer").alias("v"), F.col("p.x.start").alias("start"), F.col("p.x.n").alias("n"))
    edges = cut_lineage(steps.groupBy("u", "v").agg(F.count("*").alias("c"), F.first("n").alias("n")))
    nodes = edges.groupBy("u").agg(F.sum("c").alias("times"), F.count("*").alias("ways"))
    into = edges.where("v is not null").groupBy("v").agg(F.sum("c").alias("entered"), F.count("*").alias("ways_in"))
    # every occurrence of u goes on to v, and every occurrence of v comes from u
    times = nodes.select(F.col("u").alias("v"), F.col("times").alias("times_v"))
    only = edges.where("v is not null").join(nodes.where("ways = 1").select("u"), "u").join(into.where("ways_in = 1"), "v").join(times, "v")
    heads = contracted(only.where("entered = times_v").select("u", "v", "n"))
    placed = steps.join(small_side(cut_lineage(heads)).withColumnRenamed("node", "u"), "u", "left")
    at = (F.col("start") - F.coalesce("offset", F.lit(0))).cast("int").alias("start")
    return placed.groupBy("_id", "_text", F.coalesce("head", "u").alias("path"), at).agg(F.sum("n").cast("int").alias("n")).drop("path")


def _read(rows: DataFrame, window: int) -> DataFrame:
    """(a, b, _id, _text, start, n) of each of ``paths`` and each window of ``open`` in rows of (_id, _text, text, paths, open).

    a and b are 128 bits of the words there: BLAKE2b digests of paths, two independent hashes of windows.
    """

    def flat(lists: pa.Array, words: Words) -> list[np.ndarray]:
        """Row, first word and windows of each span in a column of lists."""
        values = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        return [row, np.asarray(values.field("start")).astype(np.int64) + words.first[row], np.asarray(values.field("n")).astype(np.int64)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column("text")):
                words = split(data, bounds, NOT_SPACE)
                paths, opened = (flat(batch.column(c).slice(first, last - first), words) for c in ("paths", "open"))
                n = opened[2]
                at = np.unique(np.repeat(opened[1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                long = _span_digests(words, paths[1], paths[1] + paths[2] + window - 1) if len(paths[1]) else paths[1:]
                other = word_hashes(words.data, words.start, words.end, 1) if len(at) else words.hash
                short = [grams(x, words.row, window)[at].view(np.int64) for x in (words.hash, other)]
                row = np.concatenate([paths[0], words.row[at]])
                start = np.concatenate([paths[1], at]) - words.first[row]
                same = [batch.column(c).take(pa.array(first + row)) for c in ("_id", "_text")]
                size = np.concatenate([paths[2], np.ones(len(at), np.int64)])
                cells = [*(np.concatenate(x) for x in zip(long, short, strict=True)), start.astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells[:2]), *same, *map(pa.array, cells[2:])], ["a", "b", "_id", "_text", "start", "n"])

    return rows.transform(map_batches, scan, "a long, b long, _id long, _text long, start int, n int")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").fill_null("").to_pylist(), batch.column("spans"), strict=True):
            words = text.encode().split()
            change = np.zeros(len(words) + 1, np.int64)
            if spans.is_valid:
                start, n = (np.asarray(spans.values.field(c)).astype(np.int64) for c in ("start", "n"))
                np.add.at(change, start, 1)
                np.add.at(change, start + n + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if gone.any() else words
            out.append((len(words), int(gone.sum()), b" ".join(kept)))
        n_words, n_removed, kept = zip(*out, strict=True) if out else ((), (), ())
        cells = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_words", "n_removed", "kept_text"])


def _digest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches, window):
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("kept_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _marked(docs: DataFrame, window: int, k: int) -> DataFrame:
    """doc_id, text and ``spans``: (first window, windows) of what an earlier document has too, null if nothing."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    found = arcs(rows, window, k)
    kmers = found.groupBy("kmer").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), (F.min("a") < F.max("a")).alias("branches"))
    repeated = kmers.where("low < high").select("kmer", "branches")
    lists = cut_lineage(found.join(repeated, "kmer").groupBy("_id", "_text").agg(F.sort_array(F.collect_set(F.struct("start", "n", "kmer", "branches"))).alias("arcs")))

    spans = F.sort_array(F.collect_list(F.struct("start", "n")))
    paths = _paths(lists).groupBy("_id", "_text").agg(spans.alias("paths"))
    open_arcs = F.transform(F.filter("arcs", lambda x: x["branches"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n")))
    wanted = cut_lineage(lists.select("_id", "_text", open_arcs.alias("open")).join(paths, ["_id", "_text"], "left"))
    texts = with_lists(rows, wanted, ["_id", "_text"]).dropDuplicates(["_id", "_text"])
    seen = _read(texts.select("_id", "_text", "text", "paths", "open"), window)
    earliest = seen.groupBy("a", "b").agg(F.min("_id").alias("owner"), F.max("_id").alias("last")).where("owner < last").drop("last")
    earliest = small_side(cut_lineage(earliest))  # written, so that a join on a popular window may be dealt out as Spark sees fit
    lost = seen.join(earliest, ["a", "b"]).where("_id > owner").groupBy("_id", "_text").agg(spans.alias("spans"))
    return with_lists(rows, cut_lineage(lost), ["_id", "_text"], "left").select(F.nullif("_id", F.lit(_NO_ID)).alias("doc_id"), "text", "spans")


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, one space between them) of every row."""
    return _marked(docs, window, k).transform(map_batches, lambda x: _cut(x, window), "doc_id long, n_words long, n_removed long, kept_text string")


def repeat_digests(docs: DataFrame, window: int = 50, k: int = 10) -> DataFrame:
    """As remove_repeats, with the SHA-256 of the kept text in its place."""
    return _marked(docs, window, k).transform(map_batches, lambda x: _digest(x, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
