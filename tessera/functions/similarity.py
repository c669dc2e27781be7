"""Similarity of two strings that no built-in function gives, as Arrow-batched functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratcliff(a: str | None, b: str | None) -> float:
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    if not a or not b:
        return 1.0 if a == b else 0.0
    return SequenceMatcher(None, a, b).ratio()


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the lower-cased, trimmed strings; both empty 1, one empty 0."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratcliff(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter string against the parts of the longer of at most its length."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    parts = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return max(_indel(a, p) for p in parts)


def _token_sort(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def indel(a: Column, b: Column, kind: str = "ratio") -> Column:
    """Normalised indel similarity from 0 to 100: of the whole ("ratio"), best part ("partial") or sorted words ("token_sort")."""
    compare = {"ratio": _indel, "partial": _partial, "token_sort": _token_sort}[kind]

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([compare((p or "").lower(), (q or "").lower()) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)
