"""Joins of ranges that overlap, by equal bins instead of by all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bin of ``width`` that the half-open range from start to end touches; none for an empty one."""
    bin_of = lambda c: F.floor(c / width)
    return rows.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end) - 1))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int = 256) -> DataFrame:
    """Rows of both sides that agree in ``keys`` and whose half-open ranges overlap, each pair once.

    The ranges meet in the bins that both touch; a pair counts in the first of them. Bounds are whole numbers, with four names that differ. A key with many ranges is dealt over
    its bins. Null keys and bounds join nothing.
    """
    (a, b), (c, d) = left_range, right_range
    met = _bins(left, a, b, width).join(_bins(right, c, d, width), [*keys, "_bin"])
    first: Column = F.floor(F.greatest(a, c) / width)
    return met.where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("_bin") == first)).drop("_bin")
