"""Arg-max, ranking and top-k with explicit ties: of equal rows the one of the smallest sequence key is first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(rows: DataFrame, groups: Sequence[str], metric: Column, sequence: str, keep: Sequence[str]) -> DataFrame:
    """The row of the largest metric in each group, as an aggregate that is combined before the shuffle; null metrics lose."""
    ranked = F.struct(metric.alias("metric"), (-F.col(sequence)).alias("order"))
    best = F.max_by(F.struct(*keep, metric.alias("metric")), ranked).alias("best")
    return rows.where(metric.isNotNull()).groupBy(*groups).agg(best).select(*groups, "best.*")


def unpivot_best(rows: DataFrame, name: str, categories: Sequence[str], sequence: str) -> DataFrame:
    """For each score column, the name and score of its best row: category, name, score."""
    long = rows.unpivot([name, sequence], list(categories), "category", "score")
    return best_per_group(long, ["category"], F.col("score"), sequence, [name]).select("category", name, F.col("metric").alias("score"))


def ranked(rows: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Rows with their 1-based ``rank`` in their group; only the first ``top``, if given, which Spark limits before the shuffle."""
    if not groups:
        if top is None:
            raise ValueError("a rank over all rows needs a limit; rank within groups instead")
        rows = rows.orderBy(*order).limit(top)
    window = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(*order)
    out = rows.withColumn("rank", F.row_number().over(window))
    return out if top is None else out.where(F.col("rank") <= top)


def names_and_rest(names: Column, shown: int = 5) -> Column:
    """The first names and how many more there are."""
    rest = F.size(names) - shown
    head = F.array_join(F.slice(names, 1, shown), ", ")
    return F.when(rest > 0, F.concat(head, F.lit(" ... +"), rest.cast("string"))).otherwise(head)


#: States of a column's sort in turn: ascending, descending, original order.
STATES = ["asc", "desc", None]


def next_state(state: Column) -> Column:
    """What a click on a column's head makes of its state; any unknown state counts as the original order."""
    return F.when(state == "asc", "desc").when(state == "desc", F.lit(None).cast("string")).otherwise("asc")


def toggled(state: Column, value: Column, original: Column) -> list[Column]:
    """Sort keys of rows in the order that ``state`` asks for: by value without regard to case, either way, or as they were.

    Nulls count as empty strings; values that compare equal keep their original order both ways.
    """
    key = F.collate(F.coalesce(value, F.lit("")), "UNICODE_CI")
    return [F.when(state == "asc", key).asc(), F.when(state == "desc", key).desc(), original.asc()]
