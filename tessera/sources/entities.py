"""Reading of nested entity documents and the reference tables that go with them.

Paths are given to Spark's readers only, so any store that Spark reads will do. A document that cannot be parsed
is no error: it comes with its text in ``_corrupt_record`` and can be set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: place and special power are strings, structs or null in the files; they are read as their JSON text.
ENTITY = T.StructType.fromDDL(
    "id string, name string, season string, motto string, story string, location string, special_power string, common_powers string, "
    "links struct<wikipedia:string,grokpedia:string,other:array<string>>, images struct<front:struct<jpg:string,webp:string>,back:struct<jpg:string,webp:string>>, "
    "has_audio boolean, audio_file string, metadata struct<extracted_date:string,last_updated:string,data_source:string,completeness:double>, _corrupt_record string"
)
PLACE = "original string, parsed struct<city:string,administrative_division:string,administrative_division_type:string,country:string,region:string>, coordinates struct<lat:double,lon:double>"
POWER = "name string, is_special boolean, levels array<struct<level:int,description:string,effect:string>>"


def read_entities(spark: SparkSession, *paths: str) -> DataFrame:
    """One canonical row per document, of either directory layout (season/entity or season/characters/entity).

    ``id`` and ``season`` fall back to the directories; provenance is in ``path``.
    """
    raw = spark.read.schema(ENTITY).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(list(paths)).withColumn("path", F.col("_metadata.file_path"))
    return canonical(raw)


def canonical(raw: DataFrame) -> DataFrame:
    """Any historical shape to one: a string place becomes its original, a string power its name, a list that is none is empty."""
    directory = lambda up: F.element_at(F.split(F.regexp_replace("path", "/characters/", "/"), "/"), -up)
    is_object = lambda c: F.startswith(F.trim(c), F.lit("{"))
    place = F.when(is_object(F.col("location")), F.from_json("location", PLACE)).when(present(F.col("location")), F.struct(F.col("location").alias("original"), F.lit(None).cast("struct<city:string,administrative_division:string,administrative_division_type:string,country:string,region:string>").alias("parsed"), F.lit(None).cast("struct<lat:double,lon:double>").alias("coordinates")))
    power = F.when(is_object(F.col("special_power")), F.from_json("special_power", POWER)).when(present(F.col("special_power")), F.struct(F.col("special_power").alias("name"), F.lit(True).alias("is_special"), F.array().cast("array<struct<level:int,description:string,effect:string>>").alias("levels")))
    powers = F.coalesce(F.from_json("common_powers", "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
    return raw.select(
        F.coalesce(F.nullif("id", F.lit("")), directory(2)).alias("id"),
        F.coalesce(F.nullif("season", F.lit("")), directory(3)).alias("season"),
        "name", "motto", "story", place.alias("place"), power.alias("special_power"), powers.alias("common_powers"),
        "links", "images", F.coalesce("has_audio", F.lit(False)).alias("has_audio"), "audio_file", "metadata", "path", "_corrupt_record",
    )


def present(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def named(entities: DataFrame) -> DataFrame:
    """Entities with an id and a name that is not "Unknown"."""
    return entities.where(present(F.col("id")) & present(F.col("name")) & (F.trim("name") != "Unknown"))


def with_sidecar(entities: DataFrame, spark: SparkSession, paths: str) -> DataFrame:
    """Entities whose story is that of a text file beside the document, where there is one with text."""
    texts = spark.read.option("wholetext", True).text(paths).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("id"), F.trim("value").alias("_text"))
    return entities.join(texts, "id", "left").withColumn("story", F.coalesce(F.nullif("_text", F.lit("")), "story")).drop("_text").select(entities.columns)


def json_map(spark: SparkSession, path: str, value: str, comment: str = "_comment") -> DataFrame:
    """(key, value) of a JSON file that holds one map; a comment key is left out."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value")).where(F.col("key") != comment)


def media(spark: SparkSession, paths: str) -> DataFrame:
    """Which images and which audio file each entity directory has; of several audio files the first by name."""
    files = spark.read.format("binaryFile").load(paths).select("path").withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("id", F.element_at(F.split("path", "/"), -2))
    has = lambda name: F.bool_or(F.col("name") == name)
    return files.groupBy("id").agg(has("front.jpg").alias("front_jpg"), has("front.webp").alias("front_webp"), has("back.jpg").alias("back_jpg"), has("back.webp").alias("back_webp"), F.min(F.when(F.col("name").rlike(r"\.(mp3|wav|ogg)$"), F.col("name"))).alias("audio_file"))
