"""Parsing of place strings and lookup in gazetteers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(place: Column) -> Column:
    return F.transform(F.split(F.trim(place), ","), lambda p: F.trim(p))


def parse(rows: DataFrame, place: str, states: DataFrame) -> DataFrame:
    """Rows with city, division and country out of "a, b, c", "a, b" (b a state of ``states`` or a country); else nulls.

    "UNKNOWN" is no place. ``states`` has columns state and country; Spark broadcasts it if it is small.
    """
    split = rows.withColumn("_p", F.when(F.upper(F.trim(place)) != "UNKNOWN", parts(F.col(place)))).withColumn("_n", F.size("_p"))
    known = states.select(F.upper("state").alias("_state"), F.col("country").alias("_of"))
    met = split.join(known, (F.col("_n") == 2) & (F.upper(F.get("_p", F.lit(1))) == F.col("_state")), "left")
    two, three, state = F.col("_n") == 2, F.col("_n") == 3, F.col("_state").isNotNull()
    return met.select(
        *rows.columns,
        F.when(two | three, F.get("_p", F.lit(0))).alias("city"),
        F.when(three | (two & state), F.get("_p", F.lit(1))).alias("division"),
        F.when(three, F.get("_p", F.lit(2))).when(two & state, F.col("_of")).when(two, F.get("_p", F.lit(1))).alias("country"),
    )


def locate(rows: DataFrame, place: str, city: str, gazetteer: DataFrame) -> DataFrame:
    """Rows with lat and lon of the whole string, else of the city, ignoring case; ``gazetteer`` has key, lat and lon, a row per place."""
    whole = gazetteer.select(F.upper("key").alias("_k1"), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"))
    part = gazetteer.select(F.upper("key").alias("_k2"), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"))
    met = rows.join(whole, F.upper(F.trim(place)) == F.col("_k1"), "left").join(part, F.upper(city) == F.col("_k2"), "left")
    return met.select(*rows.columns, F.coalesce("_lat1", "_lat2").alias("lat"), F.coalesce("_lon1", "_lon2").alias("lon"))
