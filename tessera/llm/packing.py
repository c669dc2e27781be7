"""Best-two-fit packing of tokenised documents into sequences of a fixed length (op3).

Documents are cut into pieces of at most ``capacity`` tokens. Packing needs only how many pieces there are of each length,
at most ``capacity`` numbers, so that histogram is all the driver ever sees, at any number of documents. It fills a bin greedily
with the longest pieces that fit, then replaces the bin's smallest piece with two unpacked pieces that fit
the widened gap more tightly, and repeats that bin as often as the histogram allows. Each such layout says
which ranks within a length go to which bins; pieces find their places by their rank, on the executors.

Defined results: null and empty texts are one piece, the end mark alone; very long texts, and runs of white space or letters in them, are encoded whole; equal
documents are packed each for themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage, map_batches
from tessera.llm.tokens import default_vocabulary, text_encoder

#: Pieces of one length are ranked in as many groups as keep each at about this many.
RANK_GROUP = 20_000


@dataclass
class Layout:
    """``bins`` equal bins that hold, for each (length, copies, first rank), ``copies`` pieces of that length each."""

    bins: int
    parts: list[tuple[int, int, int]]


def best_two_fit(histogram: np.ndarray, capacity: int) -> list[Layout]:
    """Layouts that use up ``histogram[length]`` pieces of each length."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    layouts = []
    while left.any():
        lengths = np.flatnonzero(left)
        take: dict[int, int] = {}
        gap = capacity
        while gap:  # greedy: as many of the longest that fits as there are
            free = lengths[: np.searchsorted(lengths, gap, "right")]
            while len(free) and left[free[-1]] <= take.get(int(free[-1]), 0):
                free = free[:-1]
            if not len(free):
                break
            x = int(free[-1])
            n = int(min(gap // x, left[x] - take.get(x, 0)))
            take[x] = take.get(x, 0) + n
            gap -= n * x
        while gap:
            smallest = min(take)
            room = gap + smallest
            rest = left.copy()
            for x, n in take.items():
                rest[x] -= n
            pair = _best_pair(rest, room, smallest)
            if pair is None:
                break
            take[smallest] -= 1
            if not take[smallest]:
                del take[smallest]
            for x in pair:
                take[x] = take.get(x, 0) + 1
            gap = room - sum(pair)
        bins = min(int(left[x]) // n for x, n in take.items())
        layouts.append(Layout(bins, [(x, n, int(used[x])) for x, n in sorted(take.items(), reverse=True)]))
        for x, n in take.items():
            left[x] -= bins * n
            used[x] += bins * n
    return layouts


def _best_pair(left: np.ndarray, room: int, over: int) -> tuple[int, int] | None:
    """Two lengths still there with the largest sum of at most ``room``, if it is over ``over``."""
    lengths = np.flatnonzero(left[: room + 1] > 0)
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, room - lengths, "right") - 1
    first, second = lengths[at >= 0], lengths[at[at >= 0]]
    twice = (first == second) & (left[first] < 2)
    if twice.any():  # only one piece of that length is there: go to the next shorter
        below = np.searchsorted(lengths, second[twice]) - 1
        second = second.copy()
        second[twice] = np.where(below >= 0, lengths[np.maximum(below, 0)], 0)
    sums = np.where(second > 0, first + second, 0)
    best = int(np.argmax(sums)) if len(sums) else 0
    return (int(first[best]), int(second[best])) if len(sums) and sums[best] > over else None


def pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and its end mark 0, cut from the back into ``capacity`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").to_pylist(), strict=True):
                ids = encoder.packed(text) + bytes(4)
                n = len(ids) // 4
                at, to = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to = to, to + capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    found = cut_lineage(pieces(docs, capacity, vocabulary or default_vocabulary()))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    layouts = best_two_fit(histogram, capacity)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for layout in layouts:
        before = 0
        for length, copies, rank in layout.parts:
            places.setdefault(length, []).append((rank, copies, first_bin, before))
            before += length * copies
        first_bin += layout.bins
    tables = {length: np.array(sorted(rows), np.int64) for length, rows in places.items()}

    groups = int(max(1, histogram.sum() // RANK_GROUP))
    salted = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_group", (F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_at").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                rows = tables[int(x)]
                hit = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                step = rank[own] - hit[:, 0]
                sequence[own] = hit[:, 2] + step // hit[:, 1]
                offset[own] = hit[:, 3] + x * (step % hit[:, 1])
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (
        ranked.join(before, ["length", "_group"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_at"))
        .transform(map_batches, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
