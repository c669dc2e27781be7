"""Levenshtein distances of many pairs of texts at once: Myers' bit-parallel columns of all pairs of a chunk stand one behind the other in one number.

Of texts of different lengths, both sides of a pair are lengthened by equally many of a character that nothing else has, which leaves their distance as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of the table of matches of a batch.
TABLE = 1 << 23
#: Words of 64 bits in which bands stand side by side.
LANES = 1 << 10


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distance of each of ``a`` from the one in its place in ``b``, which is as long or longer."""
    n, steps = len(a), max(map(len, b))
    codes = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rank = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    rank[codes] = 1
    kinds = int(rank.sum())
    bits = -(-(steps + 1) // 8) * 8
    if n > 1 and n * (kinds + 1) * bits > TABLE:
        return np.concatenate([distances(a[: n // 2], b[: n // 2]), distances(a[n // 2 :], b[n // 2 :])])
    codes = (np.cumsum(rank, dtype=np.int32) - 1)[codes]
    rows, columns = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    place = np.arange(bits)
    left, right = (np.full((n, bits), kinds, np.int32) for _ in range(2))  # the last kind is the one that fills
    left[place < rows[:, None]] = codes[: rows.sum()]
    right[place < columns[:, None]] = codes[rows.sum() :]
    high = rows + steps - columns
    inside = place < high[:, None]
    table = np.zeros((n, kinds + 1, bits), np.uint8)
    pair, at = np.nonzero(inside)
    table[pair, left[inside], at] = 1
    raw, size = np.packbits(table, axis=2, bitorder="little").tobytes(), bits // 8
    del table
    masks = [raw[i : i + size] for i in range(0, len(raw), size)]
    texts = [[masks[c] for c in text] for text in (right[:, :steps] + np.arange(n)[:, None] * (kinds + 1)).tolist()]

    def number(flags: np.ndarray) -> int:
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    full, ones = number(inside), number((place == 0) & inside)
    plus, minus = full, 0
    for column in zip(*texts, strict=True):
        equal = int.from_bytes(b"".join(column), "little")
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full ^ (full & (across | plus))), plus & across
        up, down = (up << 1 & full) | ones, down << 1 & full
        step = equal | minus
        plus, minus = down | (full ^ (full & (step | up))), up & step
    raised, lowered = (np.bitwise_count(np.frombuffer(x.to_bytes(n * size, "little"), np.uint8).reshape(n, size)).sum(1, dtype=np.int64) for x in (plus, minus))
    return steps + raised - lowered


def batches(rows: np.ndarray, columns: np.ndarray, allowed: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of pairs with bands of about a width, longest first, in batches of bounded size; ``rows`` and ``columns`` are the lengths of the two texts."""
    words = _words(columns - rows, allowed)
    key = np.where(words < 4, words, 2 * np.log2(words)).astype(np.int64)
    order = np.lexsort((-columns, key))
    key, words, at = key[order], words[order], 0
    while at < len(order):
        to = min(at + max(1, LANES // int(words[at])), int(np.searchsorted(key, key[at], "right")))
        yield order[at:to]
        at = to


def _words(longer: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Words of 64 bits that hold each band, and a bit to part it from the next."""
    return (longer + (allowed - longer) // 2 * 2 + 1) // 64 + 1


def within(a: list[str], b: list[str], allowed: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each of ``a`` from the one in its place in ``b`` is at most ``allowed``, exactly.

    A text of ``b`` is as long or longer, and by at most ``allowed``. Edits that many keep to a band of ``allowed`` + 1 diagonals, so only these are
    worked out (Hyyrö's form of Myers' columns: the band moves down a row with each column), for all pairs in one number. 64 columns at a time
    numpy looks up where their characters match; pairs that have ended, or cannot come to ``allowed`` any more, are then left out.
    """
    rows, columns = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    allowed = np.asarray(allowed, np.int64)
    n, longer = len(a), columns - rows
    width, spare = int(_words(longer, allowed).max()), (allowed - longer) // 2
    codes = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rank = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    rank[codes] = 1
    kinds = int(rank.sum()) + 1  # the last one fills both texts up to whole 64 columns, which changes no distance
    ends = -(-columns // 64) * 64
    steps = int(ends.max())
    height = steps // 64 + width
    if n > 1 and n * kinds * height * 8 > TABLE:
        return np.concatenate([within(a[: n // 2], b[: n // 2], allowed[: n // 2]), within(a[n // 2 :], b[n // 2 :], allowed[n // 2 :])])
    codes = (np.cumsum(rank, dtype=np.int32) - 1)[codes]
    own = np.arange(n) * kinds
    right = np.repeat((own + kinds - 1)[:, None], steps, 1)
    right[np.arange(steps) < columns[:, None]] = codes[rows.sum() :] + np.repeat(own, columns)
    # the shorter text begins where the band has come to its first row
    filled = ends - columns
    bits = [np.arange(x.sum()) + np.repeat(first - np.cumsum(x) + x, x) for x, first in ((rows, longer + spare), (filled, columns + spare))]
    kind = np.concatenate([codes[: rows.sum()] + np.repeat(own, rows), np.repeat(own + kinds - 1, filled)])
    table, bits = np.zeros((height, n * kinds), np.uint64), np.concatenate(bits)
    np.add.at(table.ravel(), (bits >> 6) * (n * kinds) + kind, np.uint64(1) << (bits & 63).astype(np.uint64))
    bit = np.arange(64 * width)

    def lanes(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=1, bitorder="little").view("<u8")

    # rows below the first are one more each in the first column; above it nothing changes
    plus = lanes((bit >= (longer + spare)[:, None]) & (bit < 64 * width - 1))
    minus = np.zeros_like(plus)
    corner = lanes(bit == spare[:, None])  # the diagonal that ends in the last corner
    inside = lanes((bit < 64 * width - 1)[None])
    out, live, same = np.zeros(n, bool), np.arange(n), np.zeros(n, np.int64)
    shift = np.arange(64, dtype=np.uint64)[:, None]
    for at in range(steps // 64):
        matched = np.empty((64, len(live), width), "<u8")
        asked = right[live, at * 64 : at * 64 + 64].T
        below = table[at].take(asked)
        for w in range(width):
            above = table[at + w + 1].take(asked) if at + w + 1 < height else np.zeros_like(below)
            matched[:, :, w] = below >> shift | above << np.uint64(1) << (np.uint64(63) - shift)
            below = above
        raw, size = matched.tobytes(), len(live) * width * 8
        full, target, up, down = (int.from_bytes(x.tobytes(), "little") for x in (np.tile(inside, (len(live), 1)), corner, plus, minus))
        free = 0  # columns in which the last diagonal costs nothing, counted from its bit on
        for k in range(0, 64 * size, size):
            equal = int.from_bytes(raw[k : k + size], "little")
            step = ((((equal & up) + up) ^ up) | equal | down) & full
            free += step & target
            across = down | (full ^ (step | up))
            up &= step
            step = step >> 1 & full
            down = step & across
            up |= full ^ (step | across)
        plus, minus, counted = (np.frombuffer(x.to_bytes(size, "little"), "<u8").reshape(-1, width) for x in (up, down, free))
        word, low = spare // 64, (spare % 64).astype(np.uint64)
        each = np.arange(len(live))
        value = counted[each, word] >> low | counted[each, np.minimum(word + 1, width - 1)] << np.uint64(1) << (np.uint64(63) - low)
        same = same + (value & np.uint64(127)).astype(np.int64)
        good = at * 64 + 64 - same <= allowed  # the last diagonal never falls
        ended = ends <= at * 64 + 64
        out[live[ended]] = good[ended]
        keep = good & ~ended
        if not keep.all():
            live, same, spare, allowed, ends, plus, minus, corner = (x[keep] for x in (live, same, spare, allowed, ends, plus, minus, corner))
            if not len(live):
                break
    return out
