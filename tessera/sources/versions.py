"""Versions of what a folder holds, and which of them is the newest finished one.

``manifest`` has a row for each finished version, appended when all else is written, so a write that fails is never seen and readers of the version before are not disturbed.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from tessera.operators.upsert import upsert


def name() -> str:
    """A name that sorts after all earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, path: str, schema: str, *fields: object) -> None:
    """Append a version's row, its name first."""
    spark.createDataFrame([fields], schema).coalesce(1).write.mode("append").json(f"{path}/manifest")


def newest(spark: SparkSession, path: str, schema: str) -> Row | None:
    """The row of the newest finished version; None if there is none."""
    first = schema.split()[0]
    try:
        return spark.read.schema(schema).json(f"{path}/manifest").orderBy(first, ascending=False).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write(rows: DataFrame, path: str) -> str:
    """Write ``rows`` as a new version of the table at ``path``, and return its name."""
    version = name()
    rows.write.parquet(f"{path}/rows-{version}")
    publish(rows.sparkSession, path, "version string", version)
    return version


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the newest finished version; None if there is none."""
    found = newest(spark, path, "version string")
    return found and spark.read.parquet(f"{path}/rows-{found['version']}")


def write_changes(changes: DataFrame, path: str, key: str, order: str | None = None) -> str:
    """A new version of the table at ``path``: the newest one with ``changes`` merged in by key; see ``upsert``."""
    before = read(changes.sparkSession, path)
    return write(upsert(changes.limit(0) if before is None else before, changes, key, order), path)
