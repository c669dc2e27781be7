"""Small helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows of a side that may be broadcast, once counted, and the elements of their lists; a larger side is joined by shuffle.
BROADCAST_ROWS = 250_000
#: Words of 64 bits that tell which documents may have a list.
WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one where none is named, in one-machine mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "tessera-checkpoints")


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow. Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch) as well as by rows, so long texts do not add up.

    Python workers outlive their tasks; what a task no longer needs goes back to the system, so that it is not held beside the next stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Free memory of this process returns to the system, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, lengthened until none is that of a column."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files.

    Spark deletes them when nothing refers to them any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_side(df: DataFrame, times: int = 1) -> DataFrame:
    """``df``, which is read again and therefore should be cheap, marked for broadcast if it has few enough rows and elements of lists.

    ``times``: as many more are few where they are small.
    """
    most = times * BROADCAST_ROWS
    lists = [F.coalesce(F.greatest(F.size(f.name), F.lit(1)), F.lit(1)) for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    weight = functools.reduce(lambda x, y: x + y, lists, F.lit(0 if lists else 1))
    held = df.select(weight.cast("long").alias("weight")).limit(most + 1).agg(F.sum("weight")).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def with_lists(rows: DataFrame, lists: DataFrame, keys: list[str], how: str = "inner", times: int = 1) -> DataFrame:
    """``rows`` joined with lists by document: broadcast if they are few, else hashed in memory where the shuffled texts come by.

    A table of bits, of bounded size whatever the lists' number, tells most rows that have no list; these are not shuffled, and with ``how``
    "left" they stay, without one. ``lists`` are read again and therefore should be cheap.
    """
    few = small_side(lists, times)
    if few is not lists:
        return rows.join(few, keys, how)
    word, bit, bits = fresh([*rows.columns, *lists.columns], "__word", "__bit", "__bits")
    hashed = F.xxhash64(*keys)
    places = {word: F.pmod(hashed, F.lit(WORDS)).cast("int"), bit: F.pmod(F.shiftright(hashed, 40), F.lit(64)).cast("int")}
    taken = lists.withColumns(places).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits))
    marked = rows.withColumns(places).join(F.broadcast(taken), word, "left")
    may = F.coalesce(F.expr(f"shiftrightunsigned({bits}, {bit}) & 1L"), F.lit(0)) == 1
    met = marked.where(may).drop(word, bit, bits).join(lists.hint("shuffle_hash"), keys, how)
    return met if how == "inner" else met.unionByName(marked.where(~may).drop(word, bit, bits), allowMissingColumns=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
