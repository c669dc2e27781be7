"""Fuzzy line deduplication (op7).

Lines are normalised (ASCII lower case, white space to single spaces); those of at least ``least_words`` words take part. Equal normalised
lines, told by BLAKE2b digests of their bytes, are one class. Classes nominate each other, the nominated form candidate groups, and within a group the lines'
texts are compared: two link if their edit similarity, 1 - Levenshtein distance / longer length in characters, is ``similarity`` or more. Of
each connected group the first occurrence (smallest doc_id, then line number) stays and all others go, in the same document too.

With a ``radius``, classes are nominated as the method named for this operator has it: SimHash of a line's words, weighted by length, joined on pigeonhole
blocks, which fingerprints of at most ``radius`` differing bits agree on. But a radius that blocks can serve is far tighter
than an edit similarity of 0.8. So by default (``radius`` None) fingerprints of 64 bits are taken of character n-grams (of 2 bytes in very short lines, 3 in
short ones, 5 in others) and lines meet where one of ``BANDS`` blocks, each of ``ROWS`` MinHash values of the same n-grams,
agrees and the fingerprints differ in at most ``SKETCH`` bits: lines of a Jaccard similarity s of n-grams do with about 1 - (1 - s ** ROWS) ** BANDS.

Defined results: null text stays null and has no lines; empty lines and lines of fewer words always stay; a row with a null id
keeps its lines and takes none away; rows equal in id and text are one document and lose the same lines; an empty table gives an empty one.
A very long line is one line like any other and compared whole. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tessera.llm._edits import batches, within
from tessera.llm._groups import Sets, group_links
from tessera.llm._tables import cut_lineage, fresh, map_batches, small_side, with_lists
from tessera.llm._words import NOT_SPACE, Words, digests, mix, slices, spaced, split
from tessera.llm.components import connected_components
from tessera.llm.simhash import bucketed

_NO_ID = -(1 << 63)
_SIGN = np.uint64(1 << 63)
#: Most lines in a shard in which texts are compared.
SHARD = 1024
#: MinHash values in a block, blocks, and bits in which the fingerprints of candidates may differ.
ROWS, BANDS, SKETCH = 4, 16, 24
#: Bytes of an n-gram, and of the lines from which it is taken. Lines near a limit nominate with both, so that every two alike share one.
GRAMS = ((2, 2, 18), (3, 14, 48), (5, 38, 120))
#: Longer lines hash each n-gram once, and the least hash in each of ROWS * BANDS parts stands for a permutation's minimum.
LONG = (8, 96)
#: Most lines that a line is compared with at a time.
ASKED = 128
#: Distinct lines, about, of a partition in which numpy brings equal keys together.
PART = 1 << 15
#: Nominations that a task holds before it sends them on.
HELD = 1 << 18
#: Keys of lines that a task remembers, to nominate a repeated line once.
REMEMBERED = 1 << 20
#: One line in so many is looked at first, to find keys that very many lines share.
SAMPLED = 64
#: A line's place in its order.
PLACE = [("doc", ">u8"), ("line", ">u4"), ("key", ">u8")]
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def _simhashes(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """SimHash of the words of each line, each weighing its length (15 at most), so that short common words decide little.

    Bits are counted in 16-bit lanes, four to a number.
    """
    out = np.zeros(len(first), np.uint64)
    if not len(first):
        return out
    h = np.append(mix(words.hash ^ np.uint64(0xA4093822299F31D0)), np.uint64(0))
    weight = np.append(np.minimum(words.end - words.start, 15).astype(np.uint64), np.uint64(0))
    bounds = np.stack([first, last], 1).ravel()
    total = np.add.reduceat(weight, bounds)[::2]
    for k in range(16):
        lanes = np.add.reduceat(((h >> np.uint64(k)) & np.uint64(0x0001000100010001)) * weight, bounds)[::2]
        for lane in range(4):
            count = (lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
            out |= (count * np.uint64(2) > total).astype(np.uint64) << np.uint64(16 * lane + k)
    for i in np.flatnonzero(total > 0xFFFF).tolist():  # a lane would overflow
        own, w, fp = h[first[i] : last[i]], weight[first[i] : last[i]], 0
        for bit in range(64):
            fp |= int((((own >> np.uint64(bit)) & np.uint64(1)) * w).sum() * 2 > total[i]) << bit
        out[i] = fp
    return out


def _taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes from each start to each end one behind the other, and where they start and end now."""
    n = end - start
    to = np.cumsum(n)
    return data[np.arange(n.sum()) + np.repeat(start - (to - n), n)], to - n, to


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """32 bits of the n bytes from each byte on."""
    eights = -(-len(data) // 8)
    raw = np.append(data, np.zeros(8 * eights + 8 - len(data), np.uint8))
    x = np.empty((eights, 8), np.uint64)
    for k in range(8):
        x[:, k] = raw[k : k + 8 * eights].view("<u8")
    x = x.ravel()[: len(data)]
    x &= np.uint64((1 << 8 * n) - 1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def _minima(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lines x (ROWS * BANDS): the least of the hashes from start to end under each of as many permutations."""
    bounds = np.stack([start, end], 1).ravel()  # an end is at most the last place, since an n-gram starts before its line ends
    return np.stack([np.minimum.reduceat(hashes * seed, bounds)[::2] for seed in _SEEDS], 1)


def _part_minima(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``_minima``, from one permutation whose values are dealt into parts; an empty part takes what another, fixed by its number, has."""
    parts, n = len(_SEEDS), end - start  # a power of 2
    line = np.repeat(np.arange(len(n)), n)
    inside = np.zeros(len(hashes) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    own = hashes[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    out = np.full(len(n) * parts, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, line * parts + (own >> np.uint32(8) & np.uint32(parts - 1)), own * np.uint32(0x9E3779B1))
    out = out.reshape(-1, parts)
    given, empty = out.copy(), out == 0xFFFFFFFF
    for turn in range(1, 400):
        if not empty.any():
            break
        other = (mix(np.arange(parts, dtype=np.uint64) + np.uint64(turn << 20)) % np.uint64(parts)).astype(np.int64)
        given = np.where(empty, out[:, other], given)
        empty &= out[:, other] == 0xFFFFFFFF
    return given


def _blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, fingerprints, keys of their blocks) of the lines from start to end, for each n-gram size that they take."""
    for n, low, high in (*GRAMS, (*LONG, 1 << 40)):
        own = np.flatnonzero((end - start >= max(n, low)) & (end - start <= high))
        if not len(own):
            continue
        first, last = start[own], end[own]
        if 2 * (last - first).sum() > len(data) and (first[1:] >= last[:-1]).all():
            part = data  # nearly all of it, in order
        else:
            part, first, last = _taken(data, first, last)
        minima = (_part_minima if low == LONG[1] else _minima)(_gram_hashes(part, n), first, last - n + 1)
        least = mix(minima + (np.arange(len(_SEEDS), dtype=np.uint64) << np.uint64(32)))
        prints = np.packbits((least[:, :64] >> np.uint64(63)).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
        keys = np.zeros((len(own), BANDS), np.uint64)
        for row in range(ROWS):
            keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + least[:, row::ROWS])
        yield own, prints, mix(keys + np.arange(BANDS, dtype=np.uint64) + np.uint64(n << 16))


def nominations(rows: DataFrame, least_words: int, parts: int, popular: Broadcast) -> DataFrame:
    """(part, popular, keys, ids, fps): the blocks of each line of ``rows``, with the line's name and fingerprint, many in a row: 64 bits of each in its bytes.

    Equal keys are in one of ``parts`` parts, but those of the ``popular`` ones, sorted keys, which are dealt by line.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                words, first, last, _, _ = _lines(data, bounds, least_words, False)
                joined, start, end = _spaced(words, first, last)
                names, _ = digests(joined, start, end)
                own = []
                for i, name in enumerate(names.tolist()):
                    if name not in seen:
                        seen.add(name)
                        own.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                own = np.array(own, np.int64)
                for at, prints, keys in _blocks(joined, start[own], end[own]):
                    held.append((keys.ravel(), np.repeat(names[own[at]], BANDS), np.repeat(prints, BANDS)))
                    count += keys.size
                if count > HELD:
                    yield _packed(held, parts, popular.value)
                    held, count = [], 0
        if held:
            yield _packed(held, parts, popular.value)

    return rows.where(F.col("_id") != _NO_ID).select("text").transform(map_batches, scan, "part int, popular boolean, keys binary, ids binary, fps binary")


def _packed(held: list[tuple[np.ndarray, ...]], parts: int, popular: np.ndarray) -> pa.RecordBatch:
    """A row for each part, and one more if it has popular keys."""
    keys, ids, prints = (np.concatenate(x) for x in zip(*held, strict=True))
    common = np.zeros(len(keys), bool)
    if len(popular):
        common = popular[np.minimum(np.searchsorted(popular, keys), len(popular) - 1)] == keys
    part = (np.where(common, mix(ids.view(np.uint64)), keys) % np.uint64(parts)).astype(np.int64) << 1 | common
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 15 else part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    offsets = pa.py_buffer((np.append(start, len(part)) * 8).astype(np.int32).tobytes())
    cells = [pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(x[order].tobytes())]) for x in (keys, ids, prints)]
    return pa.RecordBatch.from_arrays([pa.array((part[start] >> 1).astype(np.int32)), pa.array((part[start] & 1).astype(bool)), *cells], ["part", "popular", "keys", "ids", "fps"])


def _units(rows: DataFrame, least_words: int, parts: int, popular: DataFrame) -> DataFrame:
    """(id, group): groups of lines, by name, that nominate each other.

    Lines whose fingerprints are near in a bucket form a group, called after the smallest, so that the buckets of alike lines call it alike. A key that a
    sample shows to have very many lines is in ``popular`` and a group as it is, so that no task ever holds its lines.
    """
    common = np.array([row[0] for row in popular.collect()], np.int64).view(np.uint64)  # at most a few in 100,000 of all keys
    met = nominations(rows, least_words, parts, rows.sparkSession.sparkContext.broadcast(np.sort(common)))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for popular, *cells in zip(*(batch.column(c).to_pylist() for c in ("popular", "keys", "ids", "fps")), strict=True):
                keys, ids, prints = (np.frombuffer(x, np.int64) for x in cells)
                if popular:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], ["id", "group"])
                else:
                    held.append((keys, ids, prints))
        if held:
            keys, ids, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            same = keys[order[1:]] == keys[order[:-1]]
            order = order[np.append(same, False) | np.append(False, same)]  # most keys are those of one line
            order = order[np.lexsort((ids[order], keys[order]))]
            yield _buckets(keys[order], ids[order], prints[order])

    return met.repartitionById(parts, "part").drop("part").transform(map_batches, form, "id long, group long").distinct()


def _buckets(key: np.ndarray, line: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """(id, group) of the lines of each key, in the order of key and line, that have a near fingerprint in it."""
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line, fp = key[once], line[once], fp[once].view(np.uint64)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= SKETCH]
    ids, names = [line[two], line[two + 1]], [line[two], line[two]]
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        moved, to = _dense(fp[s : s + n], None, SKETCH)
        labels = np.arange(n)
        labels[moved] = to
        own = np.union1d(moved, to)
        ids.append(line[s + own])
        names.append(line[s + labels[own]])  # in the order of lines the label is the smallest
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, names)], ["id", "group"])


def without_parts(groups: DataFrame) -> DataFrame:
    """``groups`` (id, group) without those whose lines are all in one other group too, where each two of them meet anyway.

    A group is called after its smallest line, so one that has that line and another name is called after a smaller one, or has a key for its name.
    """
    groups = cut_lineage(groups)
    wider = groups.where("id <> group").select(F.col("id").alias("group"), F.col("group").alias("_wider"))
    there = groups.select("id", F.col("group").alias("_wider"), F.lit(1).alias("_there"))
    held = groups.join(wider, "group").join(there, ["id", "_wider"], "left").groupBy("group", "_wider").agg((F.count("*") == F.count("_there")).alias("_part"))
    return groups.join(held.where("_part").select("group").distinct(), "group", "left_anti").select("id", "group")


def _lines(data: np.ndarray, bounds: np.ndarray, least_words: int, hashed: bool = True) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of each line of enough words: first word, word after the last, row, line number in its row."""
    words = split(data, bounds, NOT_SPACE, lower=True, hashed=hashed)
    breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(breaks, words.start)
    number = before - np.searchsorted(breaks, bounds)[words.row]
    fresh = np.ones(len(number), bool)
    fresh[1:] = (number[1:] != number[:-1]) | (words.row[1:] != words.row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(number))
    enough = last - first >= least_words
    first, last = first[enough], last[enough]
    return words, first, last, words.row[first], number[first]


def _spaced(words: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and where in them each run of words starts and ends, one space between words; those that stand like that in the text are not copied."""
    between = np.zeros(len(words.start), np.int64)
    between[1:] = (words.start[1:] - words.end[:-1] != 1) | (words.data[words.start[1:] - 1] != 0x20)
    between = np.cumsum(between)
    start, end = words.start[first], words.end[last - 1]
    other = np.flatnonzero(between[last - 1] != between[first])
    if not len(other):
        return words.data, start, end
    joined, start[other], end[other] = spaced(words, first[other], last[other])
    start[other] += len(words.data)
    end[other] += len(words.data)
    return np.concatenate([words.data, joined]), start, end


def occurrences(rows: DataFrame, least_words: int, prints: bool) -> DataFrame:
    """(a, b, id, size, n, keys, fp) of each line: digest, place as bytes in order (document, line, text's hash), and bytes; n is the number of equal lines for
    the first of a stretch of rows and 0 for the rest; the keys of its blocks for a sample of first lines; and its SimHash if asked for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_key"))
            parts, sample, count = [], [], 0
            for at, _, data, bounds in slices(batch.column("text")):
                words, first, last, row, number = _lines(data, bounds, least_words, prints)
                joined, start, end = _spaced(words, first, last)
                a, b = digests(joined, start, end)
                place = np.zeros(len(row), PLACE)
                place["doc"], place["line"], place["key"] = ids[at + row].view(np.uint64) ^ _SIGN, number, keys[at + row].view(np.uint64) ^ _SIGN
                order, begin = _firsts(a, b, place)
                n = np.zeros(len(row), np.int32)
                n[order[begin]] = np.diff(np.append(begin, len(row)))
                parts.append((a, b, place, (end - start).astype(np.int32), n, _simhashes(words, first, last).view(np.int64) if prints else n))
                if not prints:
                    some = np.flatnonzero((n > 0) & (a % SAMPLED == 0))
                    sample += [(count + i, joined[start[i] : end[i]]) for i in some.tolist()]
                count += len(a)
            if not parts:
                continue
            a, b, place, size, n, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            found: list[list[int] | None] = [None] * count
            if sample:
                ends = np.cumsum([len(x) for _, x in sample])
                for own, _, blocks in _blocks(np.concatenate([x for _, x in sample]), np.append(0, ends[:-1]), ends):
                    for i, k in zip(own.tolist(), blocks.view(np.int64).tolist(), strict=True):
                        found[sample[i][0]] = (found[sample[i][0]] or []) + k
            out = [pa.array(a), pa.array(b), _binary(place), pa.array(size), pa.array(n), pa.array(found, pa.list_(pa.int64())), *[pa.array(fps)] * prints]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "id", "size", "n", "keys", "fp"][: len(out)])

    schema = "a long, b long, id binary, size int, n int, keys array<long>" + (", fp long" if prints else "")
    return rows.where(F.col("_id") != _NO_ID).select("_id", "_key", "text").transform(map_batches, scan, schema)


def _binary(place: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(20), len(place), [None, pa.py_buffer(place.astype(PLACE).tobytes())]).cast(pa.binary())


def _firsts(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by digest and place, and where in it each digest begins."""
    order = np.lexsort((place["key"], place["line"], place["doc"], b, a))
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])


def _classes(found: DataFrame, parts: int, prints: bool) -> DataFrame:
    """(a, b, own, size, n, fp): of each digest the smallest place and the number of its lines."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
        place = np.frombuffer(b"".join(table.column("id").to_pylist()), PLACE)
        order, begin = _firsts(a, b, place)
        own = table.take(pa.array(order[begin])).rename_columns({"id": "own"})
        own = own.set_column(own.column_names.index("n"), "n", pa.array(np.add.reduceat(n[order].astype(np.int64), begin)))
        yield from own.to_batches(1 << 14)

    columns = ["a", "b", "id", "size", "n", *["fp"] * prints]
    return found.where("n > 0").select(columns).repartition(parts, "a").transform(map_batches, gather, "a long, b long, own binary, size int, n long" + ", fp long" * prints)


def _part(at: int, size: int) -> Column:
    """A number out of ``id``."""
    number = F.conv(F.hex(F.substring("id", at, size)), 16, 10).cast("decimal(20,0)")
    return (number - F.lit(str(1 << 63)).cast("decimal(20,0)") if size == 8 else number).cast("long")


def _dense(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block of fingerprints, or across two, as positions; every node at most once."""
    other = left if right is None else right
    offset = 0 if right is None else len(left)
    labels = np.arange(offset + len(other))
    for at in range(0, len(left), 256):
        i, j = np.nonzero(np.bitwise_count(left[at : at + 256, None] ^ other[None, :]) <= radius)
        i, j = i + at, j + offset
        i, j = i[i != j], j[i != j]
        while len(i):
            a, b = labels[i], labels[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (labels[labels] != labels).any():
                labels = labels[labels]
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return moved, labels[moved]


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """What is left of both without what they share in front and behind."""
    for _ in range(2):
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
        a, b = a[lo:][::-1], b[lo:][::-1]
    return a, b


def _bound(a: str, b: str, allowed: int) -> int:
    """A number that their Levenshtein distance does not exceed: edits between a few pieces that both have."""
    a, b = _trimmed(a, b)
    most = max(len(a), len(b))
    if most <= allowed // 4 or min(len(a), len(b)) < 16:
        return most
    for at in (len(a) // 2, len(a) // 4, 3 * len(a) // 4):
        piece = a[at : at + 10]
        to = b.find(piece, max(0, at - allowed))
        if 0 <= to <= at + allowed:
            return _bound(a[:at], b[:to], allowed) + _bound(a[at + len(piece) :], b[to + len(piece) :], allowed)
    return most


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - Levenshtein(a, b) / max length is ``least`` or more, exactly."""
    allowed = int(max(len(a), len(b)) * (1 - least) + 1e-9)
    return abs(len(a) - len(b)) <= allowed and _within(*_trimmed(a, b), allowed)


def _within(a: str, b: str, allowed: int) -> bool:
    """Whether their Levenshtein distance is at most ``allowed``."""
    if len(a) > allowed < len(b) and _bound(a, b, allowed) <= allowed:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= allowed or not a:
        return len(b) <= allowed
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):  # Myers' bit-parallel columns
        equal = places.get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        distance += 1 if up & top else -1 if down & top else 0
        if distance - left > allowed:
            return False
        up, down = (up << 1 | 1) & full, (down << 1) & full
        step = equal | minus
        plus, minus = down | (full & ~(step | up)), up & step
    return distance <= allowed


def similar_pairs(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """``similar`` of each pair; those with bands of about a width are worked out together."""
    out, left = np.zeros(len(pairs), bool), []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        allowed = int(len(b) * (1 - least) + 1e-9)
        if len(b) - len(a) <= allowed:
            a, b = _trimmed(a, b)  # both lose as much, so b is still the longer one
            if len(b) <= allowed:
                out[k] = True
            elif a:
                left.append((k, a, b, allowed))
    rows, columns, allowed = (np.array(x, np.int64) for x in ([len(x[1]) for x in left], [len(x[2]) for x in left], [x[3] for x in left]))
    for own in batches(rows, columns, allowed):
        at, a, b, _ = zip(*(left[k] for k in own.tolist()), strict=True)
        out[list(at)] = within(list(a), list(b), allowed[own])
    return out


def _trigrams(lines: list[str]) -> np.ndarray:
    """Counts of each line's character trigrams in 1024 bins; an edit changes at most three trigrams to others."""
    sizes = np.array([len(x) for x in lines], np.int64)
    out = np.zeros((len(lines), 1024), np.int16 if sizes.max(initial=0) < 1 << 15 else np.int32)
    ends, at = np.cumsum(sizes), 0
    while at < len(lines):  # a part of the lines at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
        x = np.frombuffer("".join(lines[at:to]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(x) > 2:
            line = np.repeat(np.arange(to - at), sizes[at:to])
            bins = (mix(x[:-2] | x[1:-1] << np.uint64(21) | x[2:] << np.uint64(42)) >> np.uint64(54)).astype(np.int64)
            whole = line[:-2] == line[2:]
            out[at:to] = np.bincount((line[:-2] << 10 | bins)[whole], minlength=(to - at) << 10).reshape(-1, 1024)
        at = to
    return out


def _asking(fps: np.ndarray, sizes: np.ndarray, counts: np.ndarray | None, left: int | None, radius: int | None, least: float):
    """Yields (i, positions) to be told which of the positions' lines are similar to line i; returns the positions of lines that link."""
    sets = Sets(len(sizes))
    for i in range(len(sizes) - 1 if left is None else left):
        near = sets.apart(i, np.arange(i + 1 if left is None else left, len(sizes)))
        if not len(near):
            continue
        if radius is not None:
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        else:  # all that lengths and trigrams do not rule out
            allowed = np.maximum(sizes[near], sizes[i]) * (1 - least) + 1e-9
            fit = np.abs(sizes[near] - sizes[i]) <= allowed
            near, allowed = near[fit], allowed[fit]
            near = near[np.abs(counts[near] - counts[i]).sum(1) <= 6 * allowed]
        while len(near):
            now, near = near[:ASKED], near[ASKED:]
            for j in now[(yield i, now)].tolist():
                sets.join(i, j)
            near = sets.apart(i, near)
    return sets.pairs()


def _compare(groups: list[tuple[pa.StructArray, int | None]], radius: int | None, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions of lines that link in each group; see ``group_links``. What all groups ask for is compared together, round by round."""
    lines = [members.field("line").to_pylist() for members, _ in groups]
    counts = _trigrams([x for own in lines for x in own]) if radius is None else None
    out, asks, at = [None] * len(groups), {}, 0

    def go_on(k: int, asking, told: np.ndarray | None) -> None:
        try:
            asks[k] = asking, *asking.send(told)
        except StopIteration as end:
            out[k] = end.value

    for k, (members, left) in enumerate(groups):
        fps = members.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        own = counts[at : at + len(members)] if radius is None else None
        at += len(members)
        go_on(k, _asking(fps, np.array([len(x) for x in lines[k]]), own, left, radius, least), None)
    while asks:
        now, asks = asks, {}
        told, to = similar_pairs([(lines[k][i], lines[k][j]) for k, (_, i, near) in now.items() for j in near.tolist()], least), 0
        for k, (asking, _, near) in now.items():
            go_on(k, asking, told[to : to + len(near)])
            to += len(near)
    return out


def _candidate_texts(rows: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """(id, fp, group, line) of the lines ``wanted`` (id, fp, group), with their normalised text."""
    lists = wanted.groupBy(_part(1, 8).alias("_id"), _part(13, 8).alias("_key")).agg(F.collect_list(F.struct("id", "fp", "group")).alias("wanted"))
    lists = cut_lineage(lists)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in slices(batch.column("text")):
                words, first, last, row, number = _lines(data, bounds, least_words, False)
                lists = batch.column("wanted").slice(at, to - at)
                wants = lists.flatten()
                place = np.frombuffer(b"".join(wants.field("id").to_pylist()), PLACE)
                own = np.repeat(np.arange(to - at), lists.value_lengths().to_numpy(zero_copy_only=False))
                # rows and the numbers in them ascend
                k = np.searchsorted(row << 32 | number, own << 32 | place["line"].astype(np.int64))
                joined, start, end = _spaced(words, first[k], last[k])
                raw = joined.tobytes()
                line = pa.array([raw[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(wants.field(c) for c in ("id", "fp", "group")), line], ["id", "fp", "group", "line"])

    return with_lists(rows, lists, ["_id", "_key"], times=4).select("text", "wanted").transform(map_batches, read, "id binary, fp long, group long, line string")


def _removals(rows: DataFrame, least_words: int, radius: int | None, similarity: float) -> DataFrame:
    """(_id, _key, _gone): numbers of the lines that each document loses."""
    found = cut_lineage(occurrences(rows, least_words, radius is not None))
    parts = min(-(-found.where("n > 0").count() // PART) or 1, 1 << 16)
    classes = cut_lineage(_classes(found, parts, radius is not None))
    if radius is None:
        sample = found.where("keys is not null").select("a", F.explode("keys").alias("_key")).distinct()
        popular = sample.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * SHARD // SAMPLED).select("_key")
        groups = without_parts(_units(rows, least_words, parts, popular)).withColumnRenamed("id", "a")
        wanted = classes.select("a", "size", F.lit(0).cast("long").alias("fp"), F.col("own").alias("id")).join(groups.hint("shuffle_hash"), "a").drop("a")
    else:
        wanted = bucketed(classes.select("fp", F.col("own").alias("id")), radius, classes.count(), bucket=512).join(classes.select(F.col("own").alias("id"), "size"), "id")
    wanted = cut_lineage(wanted)
    lines = _candidate_texts(rows, wanted, least_words)
    links = group_links(lines, lambda groups: _compare(groups, radius, similarity), SHARD, sizes=wanted.select("group", "size"), together=True)
    kept = connected_components(links)
    # of a digest all go but the first, and that goes too where its component has a smaller one
    repeated = small_side(classes.where("n > 1").select("a", "b", "own"))
    gone = found.select("a", "b", "id").join(repeated, ["a", "b"]).where("id <> own").select("id").union(kept.where("node <> component").select("node"))
    return gone.groupBy(_part(1, 8).alias("_id"), _part(13, 8).alias("_key")).agg(F.collect_set(_part(9, 4)).alias("_gone"))


def drop_repeated_lines(docs: DataFrame, least_words: int = 1, radius: int | None = None, similarity: float = 0.8, report: bool = False) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` that an earlier line repeats, exactly or nearly.

    With ``report``, instead doc_id, n_lines, n_removed and kept_sha256 (of the text that stays) of every row.
    """
    own_id, own_key, lost = fresh(docs.columns, "__id", "__key", "__gone")
    keyed = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), own_key: F.xxhash64("text")})
    rows = keyed.select(F.col(own_id).alias("_id"), F.col(own_key).alias("_key"), "text").where("text is not null")
    gone = cut_lineage(_removals(rows, least_words, radius, similarity).withColumnsRenamed({"_id": own_id, "_key": own_key, "_gone": lost}))
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column(lost).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if numbers:
                    drop = set(numbers)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                texts.append(text)
                counts.append((len(lines) if text is not None else 0, len(numbers or ())))
            if not report:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)
                continue
            n, removed = zip(*counts, strict=True) if counts else ((), ())
            hashes = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    wanted = ["doc_id", "text"] if report else columns
    if report:
        keyed = keyed.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = StructType().add("doc_id", LongType()).add("n_lines", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType()) if report else docs.schema
    return with_lists(keyed, gone, [own_id, own_key], "left", times=4).select(*wanted, lost).transform(map_batches, cut, schema)
