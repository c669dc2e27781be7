"""Comparison of the members of candidate groups of any size, without all pairs of a group in one task.

A group is dealt into shards of bounded rows and bytes. Every shard is compared within and with a few pivots, members of the group's
first shard that go to all its shards. What one shard links to the first pivot needs no further
comparison with other shards' members that are linked to it too: they are in one component already. Only members that are not, the loose
ones, are compared with the other shards. In a group of copies of one text hardly any are loose, so the work follows the
group's size; a group without links still gets every pair compared, dealt over tasks by shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.llm._tables import cut_lineage, map_batches, small_side

PIVOTS = 4
#: Members, and bytes of them, from which on groups are compared together, where they are.
WAVE = (32768, 16 << 20)
#: (members, None) -> two arrays of positions that link, a forest; with a number n, only of pairs of one of the first n and one of the others
Compare = Callable[[pa.StructArray, "int | None"], "tuple[np.ndarray, np.ndarray]"]


class Sets:
    """Positions and the sets they are joined into."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[self.label[others] != self.label[i]]

    def join(self, i: int, j: int) -> None:
        x, y = self.label[i], self.label[j]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position that is not the first of its set, and the first: stars, which components join in few rounds."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.label[moved], moved


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions is linked to, over any number of links."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, out[a], low)
        np.minimum.at(new, out[b], low)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _waves(groups: Iterator[tuple[pa.StructArray, int | None]]) -> Iterator[list[tuple[pa.StructArray, int | None]]]:
    """Groups in lists of bounded members and bytes."""
    held, rows, size = [], 0, 0
    for group in groups:
        held.append(group)
        rows, size = rows + len(group[0]), size + group[0].nbytes
        if rows >= WAVE[0] or size >= WAVE[1]:
            yield held
            held, rows, size = [], 0, 0
    if held:
        yield held


def _compared(compare: Compare, together: bool, groups: Iterator[tuple[pa.StructArray, int | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of each group, in their order."""
    if together:
        for wave in _waves(groups):
            yield from compare(wave)
    else:
        for held, left in groups:
            yield compare(held, left)


def group_links(rows: DataFrame, compare: Compare, shard: int, shard_bytes: int = 8 << 20, sizes: DataFrame | None = None, together: bool = False) -> DataFrame:
    """(a, b): ids that link within the groups of ``rows`` (group, id, and what ``compare`` reads), forests that join what is linked.

    ``rows`` are read once, and twice more if there are groups of several shards. ``sizes``, if given, has a row (group, size in bytes) for each of them.
    With ``together``, ``compare`` takes a list of groups, (members, None or a number) each, and returns the links of each.
    """
    id_type = rows.schema["id"].dataType
    fields = [c for c in rows.columns if c != "group"]
    shards = F.ceil(F.count("*") / shard) if sizes is None else F.ceil(F.greatest(F.count("*") / shard, F.sum("size") / shard_bytes))
    large = cut_lineage((rows if sizes is None else sizes).groupBy("group").agg(shards.cast("int").alias("_shards")).where("_shards > 1"))
    few = small_side(large)
    dealt = rows.join(few, "group", "left").withColumn("_shards", F.coalesce("_shards", F.lit(1)))
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64("id"), F.col("_shards")).cast("int"))
    # dealt by group and shard, so that no task gets a whole group
    packed = dealt.repartition("group", "_shard").groupBy("group", "_shard").agg(F.first("_shards").alias("_shards"), F.sort_array(F.collect_set(F.struct(*fields))).alias("_rows"))
    member = packed.schema["_rows"].dataType.elementType
    to_all = F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard")
    pivots = packed.where("_shards > 1 and _shard = 0").select("group", F.slice("_rows", 1, PIVOTS).alias("_pivots"), to_all)
    some = not large.isEmpty()
    met = packed.join(pivots, ["group", "_shard"], "left") if some else packed.withColumn("_pivots", F.lit(None).cast(packed.schema["_rows"].dataType))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def members(i: int) -> tuple[pa.StructArray, pa.StructArray | None]:
                return batch.column("_rows")[i].values, batch.column("_pivots")[i].values

            count = sum(batch.column(c).value_lengths().fill_null(0).to_numpy() for c in ("_rows", "_pivots"))
            several = np.flatnonzero(count > 1).tolist()
            every = ((held if pivot is None else pa.concat_arrays([held, pivot]), None) for held, pivot in map(members, several))
            for i, (a, b) in zip(several, _compared(compare, together, every), strict=True):
                held, pivot = members(i)
                n = len(held)
                if pivot is not None:
                    held = pa.concat_arrays([held, pivot])
                ids = held.field("id")
                yield _out(ids.take(pa.array(a)), ids.take(pa.array(b)), None, None, None)
                if pivot is not None:
                    # a pivot is its own twin in the first shard
                    own = {x: k for k, x in reversed(list(enumerate(ids.to_pylist())))}
                    twins = np.array([own[x] for x in pivot.field("id").to_pylist()])
                    label = labels(len(held), np.append(a, np.arange(n, len(held))), np.append(b, twins))
                    loose = np.flatnonzero(label[:n] != label[n])
                    if len(loose):
                        same = [pa.repeat(batch.column(c)[i], len(loose)) for c in ("group", "_shard")]
                        yield _out(None, None, *same, held.take(pa.array(loose)))

    out_schema = StructType().add("a", id_type).add("b", id_type).add("group", rows.schema["group"].dataType).add("_shard", IntegerType()).add("_loose", member)
    arrow = _arrow(out_schema)

    def _out(*cells) -> pa.RecordBatch:
        n = len(next(c for c in cells if c is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c.cast(f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    found = met.select("group", "_shard", "_rows", "_pivots").transform(map_batches, within, out_schema)
    if not some:
        return found.where("a is not null").select("a", "b")
    found = cut_lineage(found)
    blocks = found.where("_loose is not null").groupBy("group", "_shard").agg(F.collect_list("_loose").alias("_loose")).withColumnRenamed("_shard", "_from")
    asked = blocks.join(few, "group").select("group", "_from", "_loose", to_all).where("_from <> _shard").repartition("group", "_shard")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(batch.column("_loose")[i].values, batch.column("_rows")[i].values) for i in range(len(batch))]
            asked = ((pa.concat_arrays([left, right]), len(left)) for left, right in pairs)
            for (left, right), (a, b) in zip(pairs, _compared(compare, together, asked), strict=True):
                both = pa.concat_arrays([left, right])
                yield pa.RecordBatch.from_arrays([both.field("id").take(pa.array(x)) for x in (a, b)], ["a", "b"])

    more = asked.join(packed.where("_shards > 1"), ["group", "_shard"]).select("_loose", "_rows").transform(map_batches, across, StructType().add("a", id_type).add("b", id_type))
    return found.where("a is not null").select("a", "b").union(more)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
