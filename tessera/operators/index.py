"""Inverted indexes, facets and substring search over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postings(rows: DataFrame, key: Column, identifier: str) -> DataFrame:
    """(key, id) without repeats; rows whose key is null or empty are left out."""
    return rows.select(key.cast("string").alias("key"), F.col(identifier).alias("id")).where("key is not null and key <> ''").distinct()


def inverted_index(rows: DataFrame, key: Column, identifier: str) -> DataFrame:
    """key, ids (sorted, distinct), n. A key's list is one row: for keys that many rows share, keep ``postings``."""
    return postings(rows, key, identifier).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def facets(rows: DataFrame, columns: Mapping[str, Column], identifier: str) -> DataFrame:
    """(facet, key, id) of several columns in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), c.cast("string").alias("key")) for name, c in columns.items()])
    long = rows.select(F.col(identifier).alias("id"), F.inline(pairs))
    return long.where("key is not null and key <> ''").select("facet", "key", "id").distinct()


def facet_counts(rows: DataFrame, columns: Mapping[str, Column], identifier: str) -> DataFrame:
    """facet, key, n: how many ids each value of each facet has."""
    return facets(rows, columns, identifier).groupBy("facet", "key").agg(F.count("*").alias("n"))


def substring_search(index: DataFrame, query: str) -> DataFrame:
    """Distinct ids of all entries of a facet index whose key contains the trimmed query, ignoring case; none for an empty query."""
    wanted = query.strip().lower()
    hits = index.where(F.contains(F.lower("key"), F.lit(wanted))) if wanted else index.limit(0)
    return hits.select("id").distinct()


def grouped_hits(hits: DataFrame, members: DataFrame, group: str, identifier: str) -> DataFrame:
    """Hits of each group that has some: group, n."""
    return members.join(hits, members[identifier] == hits["id"], "left_semi").groupBy(group).agg(F.count("*").alias("n"))


def both_ways(pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Number of distinct partners of each left value and of each right value of a link table."""
    links = pairs.select(left, right).distinct()
    return links.groupBy(left).agg(F.count("*").alias("n")), links.groupBy(right).agg(F.count("*").alias("n"))


def lists(pairs: DataFrame, left: str, right: str, least: int = 1) -> DataFrame:
    """(left, partners, n): the sorted distinct partners of each left value that has ``least`` of them; call it with the sides exchanged for the other way.

    A list is one row. For values that very many rows share, keep the link table itself, ``postings``.
    """
    links = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return links.groupBy(left).agg(F.array_sort(F.collect_set(right)).alias("partners")).withColumn("n", F.size("partners").cast("long")).where(F.col("n") >= least)


def partners_of(pairs: DataFrame, wanted: DataFrame, left: str, right: str) -> DataFrame:
    """(left, partners) of each wanted left value; an empty list where it has none."""
    empty = F.array().cast(f"array<{pairs.schema[right].dataType.simpleString()}>")
    return wanted.select(left).join(lists(pairs, left, right), left, "left").select(left, F.coalesce("partners", empty).alias("partners"))
