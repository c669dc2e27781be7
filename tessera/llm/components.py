"""Connected components of a link table, on Spark: alternating large and small stars.

Each round lets every node point its neighbours to the smallest of them, first the larger neighbours, then the
smaller; the links become stars around each component's smallest node in a logarithmic number of rounds. A
round only groups, with partial sums before each shuffle, and joins. The links of a node with many are dealt into parts for the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage

#: Links of a node that stay together in a join, at least; a node with more is dealt into parts.
PART = 500


def _both_ways(rows: DataFrame, u: Column, v: Column, other_u: Column, other_v: Column) -> DataFrame:
    """(u, v): two pairs of each row, in the partition where it is; a union would read the rows twice, in twice as many tasks."""
    return rows.select(F.inline(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in ((u, v), (other_u, other_v))))))


def _with_least(pairs: DataFrame, least: DataFrame, part: int | None) -> DataFrame:
    """``pairs`` (u, v) with what ``least`` (u, m, n) says of u; with a ``part``, the pairs of a u with more of them meet it in several tasks."""
    if part is None:
        return pairs.join(least, "u").select("u", "v", "m")
    large = least.where(F.col("n") > part).select("u", F.ceil(F.col("n") / part).cast("int").alias("_parts"))
    # at most twice the links over ``part`` rows, which the caller keeps below some hundred thousand
    dealt = pairs.join(F.broadcast(large), "u", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("_parts")), F.lit(0)).cast("int"))
    copies = least.withColumn("_part", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n"), F.lit(1)) / part).cast("int") - 1)))
    return dealt.join(copies, ["u", "_part"]).select("u", "v", "m")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    ``links`` has two columns of one orderable type. Loops, repeated links and rows with a null change nothing; no links give no rows.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    for _ in range(rounds):
        edges = cut_lineage(edges)
        both = _both_ways(edges, F.col("high"), F.col("low"), F.col("low"), F.col("high"))
        nodes = both.groupBy("u").agg(F.count_if(F.col("u") > F.col("v")).alias("up"), F.count_if(F.col("u") < F.col("v")).alias("down"))
        # stars are left when every node is either a centre or hangs on one centre alone
        loose, count, most = nodes.agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)")), F.sum("up"), F.max(F.col("up") + F.col("down"))).first()
        if not loose:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select("low", "low").distinct())
        part = max(PART, count // 100_000)
        part = part if most > part else None
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, part).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every smaller neighbour, and the node itself, now goes to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, part)
        edges = _both_ways(small, F.col("v"), F.col("m"), F.col("u"), F.col("m")).where("u > v").select(F.col("u").alias("high"), F.col("v").alias("low")).distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
