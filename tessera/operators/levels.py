"""Levels of powers: look-up by specification, level-by-level comparison, best extraction and roll-ups of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 4


def resolve(specs: DataFrame, spec: str, levels: DataFrame) -> DataFrame:
    """Rows with name, level and status of a "name:level" column against ``levels`` (name, level).

    The first colon parts name and level. Status: malformed, no level, unknown name, unknown level, or found; rows with a null
    are malformed. No row is dropped or repeated.
    """
    parts = F.split(F.col(spec), ":", 2)
    cut = specs.withColumns({"name": F.get(parts, F.lit(0)), "level": F.get(parts, F.lit(1)).try_cast("int"), "_colon": F.coalesce(F.contains(spec, F.lit(":")), F.lit(False))})
    known = levels.groupBy(F.col("name").alias("_name")).agg(F.collect_set("level").alias("_levels"))  # a reference table: a few levels a name
    met = cut.join(known, cut["name"] == known["_name"], "left")
    status = F.when(~F.col("_colon"), "malformed").when(F.col("level").isNull(), "no level").when(F.col("_name").isNull(), "unknown name").when(~F.array_contains("_levels", F.col("level")), "unknown level").otherwise("found")
    return met.select(*specs.columns, "name", "level", status.alias("status"))


def compared(entities: DataFrame, key: str, truth: DataFrame, found: DataFrame, score: Column) -> DataFrame:
    """(key, score): mean over levels 1 to 4 of ``score``, a column over ``truth`` and ``found``, which are null where missing.

    ``truth`` and ``found`` have the key, ``level`` and a column of their name, one row per key and level.
    """
    spine = entities.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"))
    both = spine.join(truth, [key, "level"], "left").join(found, [key, "level"], "left")
    return both.groupBy(key).agg(F.avg(score).alias("score"))


def best_extraction(rows: DataFrame, key: str, level: Column, text: str, order: list[str], valid: Column, missing: str = "Not found") -> DataFrame:
    """(key, level, text) for every key and level 1 to 4: the longest valid text, the first by ``order`` on ties, else ``missing``.

    One aggregate that is combined before the shuffle, so a key that many rows share costs no more than another.
    """
    first = F.min(F.struct(-F.length(text), *order, F.col(text).alias("_t")))
    best = rows.where(valid).groupBy(key, level.alias("level")).agg(first.alias("_best"))
    spine = rows.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"))
    return spine.join(best, [key, "level"], "left").select(key, "level", F.coalesce("_best._t", F.lit(missing)).alias("text"))


def issue_rollup(rows: DataFrame, group: str, issues: Column) -> DataFrame:
    """(group, analysed, issues, affected) of each group, and of all rows under "*"."""
    counted = rows.select(group, F.coalesce(F.size(issues), F.lit(0)).alias("_n"))
    rolled = counted.rollup(group).agg(F.count("*").alias("analysed"), F.sum("_n").alias("issues"), F.count_if(F.col("_n") > 0).alias("affected"), F.grouping(group).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "*").otherwise(F.col(group)).alias(group), "analysed", "issues", "affected")


def markers(rows: DataFrame, lat: str, lon: str, identifier: str) -> DataFrame:
    """(lat, lon, entities, first) of each pair of equal coordinates; rows without coordinates are left out."""
    return rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(lat, lon).agg(F.count("*").alias("entities"), F.min(identifier).alias("first"))
