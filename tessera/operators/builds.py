"""Entities joined to the levels of their first two powers, and what those add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dice


def first_two(rows: DataFrame, entity: str, order: list[Column]) -> DataFrame:
    """The first two rows of each entity, with ``place`` 0 and 1."""
    window = Window.partitionBy(entity).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window) - 1).where("place < 2")


def listed(entities: DataFrame, entity: str, powers: str) -> DataFrame:
    """entity, place, name of the first two entries of an array column."""
    return entities.select(entity, F.posexplode(powers).alias("place", "name")).where("place < 2")


def totals(effects: DataFrame, entity: str) -> DataFrame:
    """Sums over an entity's effects (green, black, rerolls, wounds, stress, replaces): dice and rerolls without the effects
    that replace, healing both without them (active) and of all (listed)."""
    active = lambda c: F.coalesce(F.sum(F.when(~F.col("replaces"), F.col(c))), F.lit(0))
    return effects.groupBy(entity).agg(
        active("green").alias("green"),
        (F.lit(dice.BASE_BLACK) + active("black")).alias("black"),
        active("rerolls").alias("rerolls"),
        active("wounds").alias("wounds_active"),
        active("stress").alias("stress_active"),
        F.coalesce(F.sum("wounds"), F.lit(0)).alias("wounds_listed"),
        F.coalesce(F.sum("stress"), F.lit(0)).alias("stress_listed"),
    )


def conversion_pick(effects: DataFrame, entity: str, value: str, level: str, place: str) -> DataFrame:
    """Of each entity's effects that have a value, that of the highest level, the first on ties."""
    pick = F.max_by(value, F.struct(F.col(level), -F.col(place)))
    return effects.where(F.col(value).isNotNull()).groupBy(entity).agg(pick.alias(value))


def compared(scenarios: DataFrame, base: str, other: str, key: str, metric: str) -> DataFrame:
    """Metric of two named scenarios side by side: difference and percent (0 from nothing)."""
    a = scenarios.where(F.col("scenario") == base).select(key, F.col(metric).alias("before"))
    b = scenarios.where(F.col("scenario") == other).select(key, F.col(metric).alias("after"))
    return a.join(b, key).select(key, "before", "after", (F.col("after") - F.col("before")).alias("difference"), dice.percent_increase(F.col("before"), F.col("after")).alias("percent"))
