"""Writers of indexes, documents and reports. Nothing is changed in place: a rewrite goes to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.merge import changed


def write_postings(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(facet, key, id) as Parquet by facet, sorted by key, so that a search on one facet reads only its files and row groups."""
    index.sortWithinPartitions("key", "id").write.partitionBy("facet").mode(mode).parquet(path)


def write_documents(rows: DataFrame, path: str, partition: str, mode: str = "errorifexists") -> None:
    """One JSON document per row, a folder per value of ``partition``."""
    rows.write.partitionBy(partition).mode(mode).json(path)


def rewrite(before: DataFrame, after: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write ``after`` to a new path, unless it is a dry run; either way return what changes."""
    if not dry_run:
        after.write.mode("errorifexists").parquet(path)
    return changed(before, after)


def season_documents(entities: DataFrame) -> DataFrame:
    """season, character_count and the summaries of its entities in order of id."""
    return entities.groupBy("season").agg(F.count("*").alias("character_count"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("characters"))


def markdown(sections: DataFrame, identifier: str) -> DataFrame:
    """(id, text): headings and lines of a document's sections in order, as Markdown; ``sections`` has pos, is_heading, line."""
    line = F.when(F.col("is_heading"), F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line"))
    return sections.groupBy(identifier).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
