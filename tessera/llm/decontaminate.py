"""Benchmark decontamination by winnowing (op9).

Test texts keep the minimum hash of each run of k-grams, chosen so that every shared span of ``window`` words shares a kept
fingerprint; test texts shorter than a window count as one window of their own length and keep its hash. Training texts are winnowed alike. A
sieve of fixed size, filled with the test fingerprints on the executors, drops the training fingerprints that cannot meet any
before they leave their task. Each that passes is extended to the windows around it, and Spark joins these to the
test windows by BLAKE2b digests of their words, so that 64-bit hashes decide nothing. Test windows in which the same items stand share one list of
items, so a passage that many items have is handed on once for each document.

The test side is never collected: the driver sees the sieve (``SIEVE_BITS`` bits at most) and the window lengths. It is broadcast in the joins only
if its rows, once counted, are few; else both sides are shuffled.

Defined results: null text has no words; a test item without words or without an id takes no part; equal
items all count; very long texts are read whole; repeated rows each get their own result; an empty benchmark marks nothing; an empty table gives an
empty result. ``clean`` keeps all columns as they are, whatever their names; ``contamination`` ignores others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage, fresh, map_batches, small_side
from tessera.llm._words import LETTER_OR_DIGIT, Words, digests, slices, spaced, split, window_minimum

#: Bits of the sieve. With more test fingerprints than about half of it, more training windows pass in vain; no result changes.
SIEVE_BITS = 1 << 24


def _fingerprints(words: Words, size: int, window: int, gram: int) -> np.ndarray:
    """For each first word of ``size`` words: the minimum hash of the window's k-grams, or the hash of fewer words than a window."""
    if size < window:
        return words.grams(size)
    g, width = words.grams(gram), window - gram + 1
    out = np.zeros(len(g), np.uint64)
    if len(g) >= width:
        out[: len(g) - width + 1] = window_minimum(g, width)
    return out


def _starts(words: Words, size: int, at: np.ndarray) -> np.ndarray:
    """Those of the places from which ``size`` words of one row follow."""
    at = at[at + size <= len(words.row)]
    return at[words.row[at] == words.row[at + size - 1]]


def _window_digests(words: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return digests(*spaced(words, at, at + size))


def test_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(size, fp, a, b, item) of every window of every test item."""
    gram = min(gram, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in slices(batch.column("text")):
                words = split(data, bounds, LETTER_OR_DIGIT, lower=True)
                n = np.minimum(np.diff(words.first), window)
                for size in np.unique(n[n > 0]).tolist():
                    own = np.flatnonzero(n[words.row] == size)
                    at = _starts(words, size, own)
                    a, b = _window_digests(words, at, size)
                    fps = _fingerprints(words, size, window, gram)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), *map(pa.array, (fps, a, b)), batch.column("item").take(pa.array(first + words.row[at]))], ["size", "fp", "a", "b", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    return items.transform(map_batches, scan, "size int, fp long, a long, b long, item string")


def _sieve(windows: DataFrame) -> dict[int, np.ndarray]:
    """For each window length, which slots the fingerprints fall into, as packed bits; put together on the executors."""
    slot = F.pmod("fp", F.lit(SIEVE_BITS))
    found = windows.select("size", F.floor(slot / 8192).alias("part"), (slot % 8192).cast("int").alias("bit")).distinct().groupBy("size", "part").agg(F.collect_list("bit").alias("bits"))
    out: dict[int, np.ndarray] = {}
    for row in found.toLocalIterator():  # a row per 8192 slots at most
        sieve = out.setdefault(row["size"], np.zeros(SIEVE_BITS // 8, np.uint8))
        bits = np.zeros(8192, bool)
        bits[row["bits"]] = True
        sieve[row["part"] * 1024 : (row["part"] + 1) * 1024] = np.packbits(bits, bitorder="little")
    return out


def _scan(batches: Iterator[pa.RecordBatch], sieves, window: int, gram: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``keep``, n_words, and ``hits``: the windows of each row whose fingerprints pass the sieve."""
    for batch in batches:
        for first, last, data, bounds in slices(batch.column("text")):
            words = split(data, bounds, LETTER_OR_DIGIT, lower=True)
            parts = []
            for size, sieve in sieves.value.items():
                fps = _fingerprints(words, size, window, gram)
                slot = fps.view(np.int64) % (8 * len(sieve))
                at = _starts(words, size, np.flatnonzero((sieve[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1))
                if len(at):
                    parts.append((at, np.full(len(at), size), *_window_digests(words, at, size)))
            at, size, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            row = words.row[at]
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(last - first + 1)).astype(np.int32)
            cells = [(at - words.first[row])[order].astype(np.int32), size[order].astype(np.int32), a[order], b[order]]
            hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in cells], ["start", "size", "a", "b"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in keep), pa.array(np.diff(words.first)), hits], [*keep, "n_words", "hits"])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` (_row, doc_id, _key, n_words), their spans that stand in the benchmark (_row, spans, sets), and the items of each set (set, item)."""
    windows = cut_lineage(test_windows(benchmark, window, gram))
    sieves = docs.sparkSession.sparkContext.broadcast(_sieve(windows))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_key"), "text")
    schema = "doc_id long, _key long, n_words long, hits array<struct<start:int,size:int,a:long,b:long>>"
    scan = partial(_scan, sieves=sieves, window=window, gram=min(gram, window), keep=["doc_id", "_key"])
    # written before the rows are numbered and read again, so that the numbers stay
    scanned = cut_lineage(rows.transform(map_batches, scan, schema).withColumn("_row", F.monotonically_increasing_id()))
    # windows in which the same items stand have one set; a window's items are put together by hash sums before
    pairs = windows.select("size", "a", "b", "item").distinct()
    named = pairs.groupBy("size", "a", "b").agg(*[F.sum(F.xxhash64(F.lit(salt), "item").cast("decimal(20,0)")).cast("string").alias(f"s{salt}") for salt in (1, 2)])
    named = cut_lineage(named.select("size", "a", "b", F.concat_ws(",", "s1", "s2").alias("set")))
    first = named.groupBy("set").agg(F.min(F.struct("size", "a", "b")).alias("w")).select("set", "w.*")
    sets = pairs.join(first, ["size", "a", "b"]).select("set", "item")
    hits = scanned.where(F.size("hits") > 0).select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    met = hits.join(small_side(named), ["size", "a", "b"])
    spans = met.groupBy("_row").agg(F.collect_list(F.struct("start", "size")).alias("spans"), F.collect_set("set").alias("sets"))
    return scanned.drop("hits"), spans, sets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = np.zeros(len(batch), np.int64)
        for i, (n, spans) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("spans"), strict=True)):
            if spans.is_valid:
                start, size = (np.asarray(spans.values.field(c)) for c in ("start", "size"))
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + size, -1)
                hit[i] = (np.cumsum(change[:-1]) > 0).sum()
        items = [sorted(x or ()) for x in batch.column("items").to_pylist()]
        named = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        out = [batch.column("doc_id"), batch.column("n_words"), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(named, pa.string()), pa.array(hit > 0)]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a test window), n_items, items_sha256 and contaminated of every row."""
    rows, spans, sets = _found(docs, benchmark, window, gram)
    spans = cut_lineage(spans)
    items = spans.select("_row", F.explode("sets").alias("set")).join(small_side(cut_lineage(sets)), "set").groupBy("_row").agg(F.collect_set("item").alias("items"))
    joined = rows.join(spans.drop("sets"), "_row", "left").join(items, "_row", "left").select("doc_id", "n_words", "spans", "items")
    return joined.transform(map_batches, _counted, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The rows of ``docs``, as they are, in which no test window stands."""
    rows, spans, _ = _found(docs, benchmark, window, gram)
    own, key = fresh(docs.columns, "__id", "__key")
    bad = cut_lineage(rows.join(spans.select("_row"), "_row").select(F.col("doc_id").alias(own), F.col("_key").alias(key)).distinct())
    keyed = docs.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64("text")})
    # whether a row is hit follows from its text; ids may be null
    same = keyed[own].eqNullSafe(F.col("b." + own)) & (keyed[key] == F.col("b." + key))
    return keyed.join(small_side(bad).alias("b"), same, "left_anti").drop(own, key)
