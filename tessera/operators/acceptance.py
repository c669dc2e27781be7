"""Names taken line by line, each once, up to a limit, as an aggregate: no document's lines are gathered in one row.

Reading a document from its start, taking every accepted name that is not taken yet and stopping at the limit, gives
the names with the earliest first accepted lines. So the first line of each name is found before the shuffle, and the limit is a rank that Spark cuts before its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import gates
from tessera.operators.ranking import ranked


def first_accepted(candidates: DataFrame, groups: Sequence[str], name: str, position: str, accepted: Column, most: int = 2) -> DataFrame:
    """groups, name, position of its first accepted candidate, rank: the first ``most`` names of each group. Of names at one position the smaller is first."""
    firsts = candidates.where(accepted & F.col(name).isNotNull()).groupBy(*groups, name).agg(F.min(position).alias(position))
    return ranked(firsts, [F.col(position), F.col(name)], groups, most)


def judged(candidates: DataFrame, line: str, name: str, previous: str) -> DataFrame:
    """Candidates with ``verdict``; likeness is computed once for each distinct pair of line and name."""
    pairs = candidates.select(F.trim(line).alias("_line"), F.col(name).alias("_name")).where("_line is not null and _name is not null").distinct()
    known = pairs.select("_line", "_name", gates.likeness(F.col("_line"), F.col("_name")).alias("_like"))
    met = candidates.join(known, (F.trim(candidates[line]) == known["_line"]) & (candidates[name] == known["_name"]), "left")
    return met.withColumn("verdict", gates.verdict(F.col(line), F.col(name), F.col(previous), F.col("_like"))).drop("_line", "_name", "_like")
