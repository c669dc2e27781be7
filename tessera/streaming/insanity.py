"""The insanity track over ordered events: in batch, without a limit on a key's events, and as a stream.

A step is a map from the 22 slots to the slots, and maps compose in any grouping that keeps the order. So a key's
events are folded in pieces of at most ``PIECE`` to one map each, the maps of a day to one, and the days' maps are applied in
order: no row holds more than a piece's events, a day's maps or a key's days.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.tracks import DEATH, SWIRLS, advance


#: Events that are folded at once.
PIECE = 4096


def _composed(maps: Column) -> Column:
    """One map that does what the maps do in their order."""
    slots = F.sequence(F.lit(0), F.lit(DEATH))
    return F.aggregate(maps, slots, lambda done, m: F.transform(done, lambda slot: F.get(m, slot)))


def final_insanity(events: DataFrame, key: str, at: str, tie: str, steps: str) -> DataFrame:
    """(key, insanity) after all of each key's events in order of time and tie; ``steps`` counts tentacles, null is none.

    Hours of a key are numbered in the order of their events, which Spark sorts with spill, and grouped where they lie, without another shuffle.
    """
    piece = events.select(key, F.to_date(at).alias("_day"), F.hour(at).alias("_hour"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.coalesce(F.col(steps).cast("int"), F.lit(0)).alias("n")).alias("e"))
    hour = [key, "_day", "_hour"]
    numbered = piece.withColumn("_piece", F.floor((F.row_number().over(Window.partitionBy(*hour).orderBy("e.at", "e.tie", "e.n")) - 1) / PIECE))
    runs = numbered.groupBy(*hour, "_piece").agg(F.array_sort(F.collect_list("e")).alias("es"))
    slots = F.sequence(F.lit(0), F.lit(DEATH))
    folded = runs.select(*hour, "_piece", F.transform(slots, lambda s: F.aggregate(F.transform("es", lambda e: e["n"]), s, lambda a, n: advance(a, n))).alias("map"))
    in_order = lambda *parts: F.transform(F.array_sort(F.collect_list(F.struct(*parts, "map"))), lambda m: m["map"])
    days = folded.groupBy(key, "_day").agg(in_order("_hour", "_piece").alias("maps")).select(key, "_day", _composed(F.col("maps")).alias("map"))
    return days.groupBy(key).agg(in_order("_day").alias("maps")).select(key, F.get(_composed(F.col("maps")), F.lit(0)).alias("insanity"))


def _step(at: int, n: int) -> int:
    end = next((s for s in SWIRLS if at < s), DEATH)
    return min(at + n, end, DEATH)


def stream_insanity(events: DataFrame, key: str, at: str, tie: str, steps: str, late: str = "1 hour"):
    """A stream of (key, insanity, events) after each batch; within a batch a key's events are taken in order of time and tie.

    State is one slot and a count per key. Events later than the watermark allows are dropped by Spark.
    """

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot, seen = state.get if state.exists else (0, 0)
        batch = pd.concat(list(frames)).sort_values([at, tie])
        for n in batch[steps].fillna(0).astype(int):
            slot, seen = _step(slot, n), seen + 1
        state.update((slot, seen))
        yield pd.DataFrame({key: [keys[0]], "insanity": [slot], "events": [seen]})

    kind = dict(events.dtypes)[key]
    marked = events.withWatermark(at, late).select(key, at, tie, steps)
    return marked.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, insanity int, events long", "slot int, seen long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each kind in tumbling windows, with a watermark, for batch and stream alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("_w"), kind).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), kind, "n")
