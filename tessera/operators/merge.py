"""Merging of two versions of records, overlays and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def longer(old: Column, new: Column) -> Column:
    """The longer text; the old one if they are as long; whichever is there if one is missing."""
    a, b = filled(old), filled(new)
    return F.when(F.coalesce(F.length(b), F.lit(0)) > F.coalesce(F.length(a), F.lit(0)), b).otherwise(a)


def merge(old: DataFrame, new: DataFrame, key: str, prefer_new: Sequence[str] = (), prefer_old: Sequence[str] = (), prefer_longer: Sequence[str] = ()) -> DataFrame:
    """Full outer join on the key; each column by its precedence, empty strings counting as missing."""
    o, n = old.alias("o"), new.alias("n")
    pick = {c: F.coalesce(filled(F.col(f"n.{c}")), filled(F.col(f"o.{c}"))) for c in prefer_new}
    pick |= {c: F.coalesce(filled(F.col(f"o.{c}")), filled(F.col(f"n.{c}"))) for c in prefer_old}
    pick |= {c: longer(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in prefer_longer}
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[v.alias(c) for c, v in pick.items()])


def overlay(kept: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """All rows of ``kept``, and those of ``added`` whose key is not there yet."""
    return kept.unionByName(added.join(kept, key, "left_anti"))


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known."""
    return rows.join(known, key, "left_anti")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a rewrite would add and remove: rows with ``change`` + or -."""
    return after.exceptAll(before).withColumn("change", F.lit("+")).union(before.exceptAll(after).withColumn("change", F.lit("-")))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def set_difference(truth: Column, found: Column) -> list[Column]:
    """Counts of tokens in common, missing and extra."""
    t, f = tokens(truth), tokens(found)
    return [F.size(F.array_intersect(t, f)).alias("common"), F.size(F.array_except(t, f)).alias("missing"), F.size(F.array_except(f, t)).alias("extra")]


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
