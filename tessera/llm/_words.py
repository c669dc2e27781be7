"""Vectorised word splitting and hashing over Arrow text, shared by the operators that compare word sequences.

Texts are handled a few MB at a time straight from Arrow's buffers, so a task's memory does not
follow its number of rows. 64-bit hashes only ever nominate candidates; where equality is decided without the words side by
side, it is by BLAKE2b digests of the words' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 512 << 10
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longest word that is hashed in numpy, eight bytes a round.
_LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: True where a byte belongs to a word. Bytes over 0x7F always do, so UTF-8 characters stay whole.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LETTER_OR_DIGIT[_lo : _hi + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each word: its length and its bytes, eight at a time, each round mixed over the whole number."""
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(0x243F6A8885A308D3 + (seed << 32)))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    own, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(own):
        chunk = np.ascontiguousarray(eights[start[own] + at]).view("<u8")[:, 0] & _MASKS[np.minimum(size[own] - at, 8)]
        out[own] = mix((out[own] ^ chunk) * _STEP)
        at += 8
        own = own[size[own] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the BLAKE2b digests, of 128 bits, of some stretches of bytes: equal bytes, and no others, have equal digests."""
    raw = memoryview(np.ascontiguousarray(data))
    both = b"".join([blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    halves = np.frombuffer(both, "<i8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


@dataclass
class Words:
    """Words of some consecutive rows: byte bounds in ``data``, a hash each, and each row's word range."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row and one past the last: index of its first word

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        raw = self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""
        at = int(self.start[i]) if j > i else 0
        return b" ".join([raw[s - at : e - at] for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; 0 where fewer are left in its row."""
        return grams(self.hash, self.row, n)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    if len(hashes) < n:
        return out
    have, total, block, size = None, 0, hashes, 1
    while True:  # binary powers of n, longest runs by doubling
        if n & size:
            have = block if have is None else have[: len(block) - total] * np.uint64(0xD6E8FEB86659FD93) + block[total:] if total else block
            total += size
        if size * 2 > n:
            break
        block = mix(block[:-size] * np.uint64(0xD6E8FEB86659FD93) + block[size:])
        size *= 2
    m = len(hashes) - n + 1
    whole = row[:m] == row[n - 1 :]
    out[:m] = np.where(whole, mix(have[:m]) | np.uint64(1), 0)
    return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row bounds in them) of runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def split(data: np.ndarray, bounds: np.ndarray, member: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words (maximal runs of ``member`` bytes within a row) of the rows that ``bounds`` marks in ``data``; without ``hashed``, their hashes are 0."""
    if lower:
        data = np.frombuffer(data.tobytes().translate(LOWER.tobytes()), np.uint8)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = np.frombuffer(data.tobytes().translate(member.tobytes()), bool)
    edge = np.empty(n + 1, bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    # a row's end also ends a word: such words are cut by adding a second bound there
    cuts = np.unique(bounds[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]))
    start, end = marks[0::2], marks[1::2]
    hashes = word_hashes(data, start, end) if hashed else np.zeros(len(start), np.uint64)
    row = np.searchsorted(bounds, start, "right") - 1
    first = np.searchsorted(start, bounds, "left")
    return Words(data, start, end, hashes, row, first)


def spaced(words: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some runs of words, with one space behind each word, and each run's start and end (without that space) in them."""
    n = last - first
    if not n.sum():
        return np.zeros(0, np.uint8), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    index = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    size = words.end[index] - words.start[index] + 1
    to = np.cumsum(size)
    source = np.arange(to[-1]) + np.repeat(words.start[index] - (to - size), size)
    out = words.data[np.minimum(source, len(words.data) - 1)]
    out[to - 1] = 0x20
    ends = np.append(0, to)[np.cumsum(n)]
    return out, np.append(0, ends[:-1]), np.maximum(ends - 1, np.append(0, ends[:-1]))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
