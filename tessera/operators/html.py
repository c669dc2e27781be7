"""Titles, links, tokens and paragraphs of HTML strings, by regular expression within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'))


def distinct_links(rows: DataFrame, identifier: str, html: str) -> DataFrame:
    """(id, pos, url): each target once, at its first place, without its fragment; empty ones dropped."""
    every = rows.select(identifier, F.posexplode(links(F.col(html))).alias("pos", "url")).withColumn("url", clean_url(F.col("url")))
    return every.where("url <> ''").groupBy(identifier, "url").agg(F.min("pos").alias("pos"))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def file_name(url: Column) -> Column:
    """Last part of the path without query, size suffix and extension."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    return F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), r"-\d+x\d+$", "")


def blocks(rows: DataFrame, identifier: str, html: str) -> DataFrame:
    """(id, pos, tag, content): headings and paragraphs in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:h[1-6]|p)\b[^>]*>.*?</(?:h[1-6]|p)>)"))
    every = rows.select(identifier, F.posexplode(found).alias("pos", "raw"))
    return every.select(identifier, "pos", F.lower(F.regexp_extract("raw", r"(?i)^<(h[1-6]|p)", 1)).alias("tag"), strip_tags(F.col("raw")).alias("content"))


def under_headings(rows: DataFrame, identifier: str, html: str) -> DataFrame:
    """Paragraphs with the nearest heading before them: (id, pos, heading, content)."""
    window = Window.partitionBy(identifier).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("tag") != "p", F.col("content")), ignorenulls=True).over(window)
    return blocks(rows, identifier, html).withColumn("heading", heading).where("tag = 'p'").select(identifier, "pos", "heading", "content")
