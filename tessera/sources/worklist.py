"""Which entity folders there are to work on: a listing of names, whose files' contents are never read.

Layouts are season/characters/entity/file and season/entity/file; in a season that has a characters folder, only that counts.
A folder without any file is not seen, since stores list files; files that lie deeper than an entity's folder are not its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of images, the preferred ones first.
IMAGES = ["webp", "jpg", "jpeg"]


def folders(spark: SparkSession, root: str) -> DataFrame:
    """season, entity, folder (below ``root``), front, back (file of the preferred kind, or null) and has_zip (entity.zip) of every entity folder."""
    base = re.sub(r"^[a-z0-9+.-]+:(//)?", "", root.rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.split(F.regexp_replace("path", rf"^.*?\Q{base}\E/", ""), "/").alias("at"))
    part = lambda i: F.get("at", F.lit(i))
    deep = part(1) == "characters"
    entity = F.when(deep & (F.size("at") == 4), part(2)).when(~deep & (F.size("at") == 3), part(1))
    named = files.where(F.size("at") >= 3).select(part(0).alias("season"), deep.alias("deep"), entity.alias("entity"), F.element_at("at", -1).alias("file"))
    image = lambda side: F.coalesce(*[F.max(F.when(F.col("file") == f"{side}.{kind}", F.col("file"))) for kind in IMAGES])
    grouped = named.groupBy("season", "deep", "entity").agg(image("front").alias("front"), image("back").alias("back"), F.bool_or(F.col("file") == F.concat("entity", F.lit(".zip"))).alias("has_zip"))
    ruled = grouped.withColumn("_ruled", F.bool_or("deep").over(Window.partitionBy("season")))
    kept = ruled.where(F.col("entity").isNotNull() & (F.col("deep") == F.col("_ruled")))
    folder = F.concat_ws("/", "season", F.when(F.col("deep"), "characters"), "entity")
    return kept.select("season", "entity", folder.alias("folder"), "front", "back", "has_zip")


def work_list(spark: SparkSession, root: str, season: str | None = None, entity: str | None = None) -> DataFrame:
    """Folders to work on: in bulk those with an image or a zip, or the one of a named entity (lower-cased), whatever it holds, in the first season that has it."""
    found = folders(spark, root)
    if season is not None:
        found = found.where(F.col("season") == season)
    if entity is None:
        return found.where(F.col("front").isNotNull() | F.col("back").isNotNull() | F.col("has_zip"))
    return found.where(F.col("entity") == entity.lower()).orderBy("season").limit(1)
