"""Readers of the reference tables that go with entity documents: powers by level, assignments, gazetteer, speakers, saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lookup

_POWERS = "array<struct<name:string,is_special:boolean,levels:array<struct<level:int,description:string,effect:string>>>>"


def power_levels(spark: SparkSession, path: str) -> DataFrame:
    """(name, level, description, effect) of a JSON list of powers; of powers of one name the last counts."""
    whole = spark.read.option("wholetext", True).text(path)
    powers = whole.select(F.posexplode(F.from_json("value", _POWERS)).alias("_at", "p")).select("_at", "p.name", "p.levels").where("name is not null")
    return lookup.last_wins(powers, ["name"], ["_at"]).select("name", F.inline("levels"))


def assignments(spark: SparkSession, path: str, section: str = "character_traits") -> DataFrame:
    """(key, powers): lists by the first word of the entity's name in lower case, leading titles left out; of equal keys the last counts."""
    whole = spark.read.option("wholetext", True).text(path)
    lists = whole.select(F.from_json("value", "map<string,map<string,array<string>>>")[section].alias("m")).where("m is not null")
    rows = lists.select(F.posexplode("m").alias("_at", "name", "powers")).withColumn("key", first_name(F.col("name"))).where("key <> ''")
    return lookup.last_wins(rows.select("key", "powers", "_at"), ["key"], ["_at"]).select("key", "powers")


def first_name(name):
    """First word in lower case, without a title before it or a number behind it."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"\s*\([^)]*\)\s*$|^(lord|lady|sir|sister|father|doctor|dr\.?|professor|the)\s+", ""))
    return F.split(plain, r"\s+")[0]


def gazetteer(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sub-tables of a JSON object of maps, by name, each (key, value); a file without one gives an empty table for it."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "struct<divisions:map<string,string>,regions:map<string,string>,states:map<string,string>,coordinates:map<string,struct<lat:double,lon:double>>>").alias("t"))
    return {name: whole.where(F.col(f"t.{name}").isNotNull()).select(F.explode(f"t.{name}").alias("key", "value")) for name in ("divisions", "regions", "states", "coordinates")}


def speakers(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name): the known name, or one made of the id."""
    return ids.join(known, "id", "left").select("id", F.coalesce("name", F.concat(F.lit("Speaker "), F.substring("id", 2, 1000))).alias("name"))


def saved_results(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per saved result, (name, category, score, seconds, text); numbers that are absent are 0, texts empty."""
    raw = spark.read.schema("name string, category string, score double, seconds double, text string").option("multiLine", True).json(list(paths))
    return raw.select("name", "category", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("text", F.lit("")).alias("text"))
