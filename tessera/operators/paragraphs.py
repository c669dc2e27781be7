"""The best paragraph of a text, with the runner-up behind it where that adds to it.

Paragraphs that are rows are ranked per group; Spark keeps the two first of each group before the shuffle, so a group with very many
paragraphs sends two from each task. Paragraphs of one text are ranked in the row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cards import paragraph_score
from tessera.functions.scoring import let
from tessera.operators.ranking import ranked

#: The runner-up is added behind a best paragraph of more than so many points, if less than so much of its words are in it.
GOOD, SHARED = 50, 0.3


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def adds(best: Column, second: Column, score: Column) -> Column:
    """Whether ``second`` belongs behind ``best``: a good best paragraph and few shared words."""
    bag = _words(second)
    return (score > GOOD) & (F.size(F.array_intersect(_words(best), bag)) < F.size(bag) * SHARED)


def joined(best: Column, second: Column, score: Column) -> Column:
    return F.when(second.isNotNull() & adds(best, second, score), F.concat(best, F.lit(" "), second)).otherwise(best)


def split(text: Column) -> Column:
    """Paragraphs between empty lines; the lines themselves where no empty line parts the text. Trimmed, empty ones dropped."""
    parts = let(F.split(text, r"\n\s*\n+"), lambda q: F.when(F.size(q) == 1, F.split(text, "\n")).otherwise(q))
    return F.filter(F.transform(parts, _stripped), lambda p: p != "")


def score(paragraph: Column, *others: Column) -> Column:
    """Story score; -1000 where the paragraph holds one of the other fields (name, place, motto), ignoring case."""
    holds = F.lit(False)
    for other in others:
        holds = holds | F.coalesce((other != "") & F.contains(F.lower(paragraph), F.lower(other)), F.lit(False))
    return F.when(holds, -1000).otherwise(paragraph_score(paragraph))


def story(text: Column, *others: Column) -> Column:
    """Struct of the story of a text, its best paragraph's score and how many paragraphs it holds (1 or 2); null without a positive score. First of equals wins."""
    scored = F.transform(split(text), lambda p, i: F.struct((-score(p, *others)).alias("order"), i.alias("i"), p.alias("p")))
    two = F.slice(F.array_sort(F.filter(scored, lambda x: x["order"] < 0)), 1, 2)

    def told(top: Column) -> Column:
        best, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
        whole = let(joined(best["p"], second["p"], -best["order"]), lambda w: F.struct(w.alias("story"), (-best["order"]).alias("score"), F.when(F.length(w) > F.length(best["p"]), 2).otherwise(1).alias("parts")))
        return F.when(F.size(top) > 0, whole)

    return let(two, told)


def best_of_groups(rows: DataFrame, groups: Sequence[str], text: str, sequence: str, points: Column) -> DataFrame:
    """groups, story, score, parts of paragraphs that are rows; groups without a positive score have no row."""
    scored = rows.select(*groups, F.col(text).alias("_p"), F.col(sequence).alias("_i"), points.alias("_score")).where("_score > 0")
    top = ranked(scored, [F.col("_score").desc(), F.col("_i"), F.col("_p")], groups, 2)
    at = lambda c, n: F.max(F.when(F.col("rank") == n, F.col(c)))
    two = top.groupBy(*groups).agg(at("_p", 1).alias("_best"), at("_p", 2).alias("_second"), at("_score", 1).alias("score"))
    whole = joined(F.col("_best"), F.col("_second"), F.col("score"))
    return two.select(*groups, whole.alias("story"), "score", F.when(F.length(whole) > F.length("_best"), 2).otherwise(1).alias("parts"))
