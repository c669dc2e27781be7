"""Matching of lines and names against small vocabularies that are literals of the query."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import indel


def ordered_match(text: Column, figures: Sequence[str]) -> Column:
    """The first figure, in table order, that the name equals, contains or is contained in, ignoring case; else null."""
    low = F.lower(F.trim(text))
    rules = [F.when((low == f.lower()) | F.contains(low, F.lit(f.lower())) | ((F.length(low) > 4) & F.contains(F.lit(f.lower()), low)), f) for f in figures]
    return F.coalesce(*rules)


def containing_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule whose key stands in the text, ignoring case; the trimmed text itself if none does."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(k)), v) for k, v in rules], F.trim(text))


def exact_layers(line: Column, vocabulary: Sequence[str], tolerance: int = 10) -> Column:
    """Entry that a line equals, else holds between word bounds, else is contained in up to a length difference; in that order."""
    low = F.lower(F.trim(line))
    equal = [F.when(low == v.lower(), v) for v in vocabulary]
    bounded = [F.when(low.rlike(rf"\b{re.escape(v.lower())}\b"), v) for v in vocabulary]
    inside = [F.when((F.length(low) > 3) & F.contains(F.lit(v.lower()), low) & (F.abs(F.length(low) - len(v)) <= tolerance), v) for v in vocabulary]
    return F.coalesce(*equal, *bounded, *inside)


def fuzzy(rows: DataFrame, line: str, vocabulary: Sequence[str], least: float = 60.0) -> DataFrame:
    """Rows with ``match`` and ``score``: the entry of the best of three ratios, if that is ``least`` or more.

    Distinct lines are scored once; the vocabulary stands in the query, so its size is that of the query.
    """
    pairs = rows.select(F.col(line).alias("_line")).where("_line is not null").distinct().select("_line", F.posexplode(F.array(*[F.lit(v) for v in vocabulary])).alias("_seq", "_entry"))
    score = F.greatest(*[indel(F.col("_line"), F.col("_entry"), kind) for kind in ("ratio", "partial", "token_sort")])
    best = pairs.withColumn("_score", score).groupBy("_line").agg(F.max_by(F.struct("_entry", "_score"), F.struct(F.col("_score"), -F.col("_seq"))).alias("_best"))
    good = best.where(F.col("_best._score") >= least)
    return rows.join(good, rows[line] == good["_line"], "left").select(*rows.columns, F.col("_best._entry").alias("match"), F.col("_best._score").alias("score"))


def nearest_by_edits(word: Column, vocabulary: Sequence[str]) -> Column:
    """The entry of the smallest Levenshtein distance, the first on ties."""
    return F.array_min(F.array(*[F.struct(F.levenshtein(F.lower(word), F.lit(v.lower())).alias("distance"), F.lit(i).alias("seq"), F.lit(v).alias("entry")) for i, v in enumerate(vocabulary)]))["entry"]


def first_name(name: Column) -> Column:
    """Lower-cased first word without titles and marks: the key of assignment tables."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"^(dr|mr|mrs|ms|lord|lady|sir)\.?\s+", "")
    return F.regexp_replace(F.get(F.split(plain, r"\s+"), F.lit(0)), "[^a-z0-9]", "")
