"""Point and list look-ups, last-wins tables, fallbacks and overrides.

Look-ups by key are filters that reach the scan; reference tables are small by nature, and Spark decides by their size whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_partition(rows: DataFrame, partition: str, value: object) -> DataFrame:
    """Rows of one partition; no rows for a null."""
    return rows.where(F.col(partition) == F.lit(value))


def detail(rows: DataFrame, partition: str, value: object, identifier: str, wanted: object) -> DataFrame:
    """The rows with that id in that partition."""
    return in_partition(rows, partition, value).where(F.col(identifier) == F.lit(wanted))


def by_name(rows: DataFrame, name: str, wanted: str, order: str) -> DataFrame:
    """The first row, in the order of ``order``, whose name is ``wanted`` but for case; none for no match."""
    return rows.where(F.lower(name) == wanted.lower()).orderBy(order).limit(1)


def by_part_of_name(rows: DataFrame, name: str, wanted: str, order: str) -> DataFrame:
    """As ``by_name``, but a name that only contains ``wanted`` will do where no name equals it."""
    low = F.lower(name)
    return rows.where(F.contains(low, F.lit(wanted.lower()))).orderBy((low != wanted.lower()).cast("int"), order).limit(1)


def listing(rows: DataFrame, partition: str, identifier: str) -> DataFrame:
    """Distinct (partition, id), both present, in order."""
    return rows.where(F.col(partition).isNotNull() & F.col(identifier).isNotNull()).select(partition, identifier).distinct().orderBy(partition, identifier)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that share ``keys`` the last in the order of ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def with_default(rows: DataFrame, known: DataFrame, on: Column, values: dict[str, object]) -> DataFrame:
    """``rows`` with the columns ``values`` of ``known``, or their defaults where nothing is known."""
    joined = rows.join(known, on, "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(known[c], F.lit(default)).alias(c) for c, default in values.items()])


def overridden(rows: DataFrame, manual: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` whose ``column`` is that of ``manual`` (keys and ``column``) where there is one, and ``changed``: whether it differs from before."""
    new = manual.select(*keys, F.col(column).alias("_new"))
    joined = rows.join(new, keys, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
    return joined.select(*[F.coalesce("_new", column).alias(c) if c == column else c for c in rows.columns], changed.alias("changed"))


def known_figure(rows: DataFrame, identifier: str, name: str, manual: DataFrame, figures: DataFrame, least: int = 3) -> DataFrame:
    """``rows`` with ``figure``: by hand for an id of ``manual`` (id, figure), else that of the same name but for case (name, figure), of ``least`` characters."""
    hand = manual.select(F.col("id").alias("_id"), F.col("figure").alias("_by_hand"))
    same = figures.select(F.lower(F.trim("name")).alias("_name"), F.col("figure").alias("_by_name"))
    key = F.lower(F.trim(F.col(name)))
    joined = rows.join(hand, F.col(identifier) == F.col("_id"), "left").join(same, (key == F.col("_name")) & (F.length(key) >= least), "left")
    return joined.select(*rows.columns, F.coalesce("_by_hand", "_by_name").alias("figure"))


def pending(rows: DataFrame, required: list[str], force: bool = False) -> DataFrame:
    """Rows that still lack one of ``required``; all rows with ``force``."""
    missing = [F.col(c).isNull() for c in required]
    lacking = missing[0]
    for c in missing[1:]:
        lacking |= c
    return rows if force else rows.where(lacking)


def pairs_by_side(rows: DataFrame, name: str, is_back: Column, value: str, order: str) -> DataFrame:
    """name, front, back: the last value of each side, in the order of ``order``; null where a side has none."""
    side = lambda flag: F.max_by(F.when(flag, F.col(value)), F.when(flag, F.col(order)))
    return rows.groupBy(name).agg(side(~is_back).alias("front"), side(is_back).alias("back"))


def status_counts(rows: DataFrame, group: str, status: Column, names: list[str]) -> DataFrame:
    """group, a count for each of ``names``, and ``other``."""
    counts = [F.count_if(status == n).alias(n) for n in names]
    return rows.groupBy(group).agg(*counts, F.count_if(~F.coalesce(status.isin(names), F.lit(False))).alias("other"))
