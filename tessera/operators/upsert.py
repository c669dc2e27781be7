"""Changes merged into nested records, field by field down the schema.

A field that the change leaves out, or has as null, as an empty text or as an empty list, keeps what was there; structs are merged field by field, of maps the entries,
and fields that only one side's schema has are kept. A change to a key that is not there is a new record. Null keys are left out of the changes; records with one stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType


def union_type(old: DataType, new: DataType) -> DataType:
    """The type that holds both: of structs all fields, the old ones first; otherwise the old one, to which the new is cast."""
    if not (isinstance(old, StructType) and isinstance(new, StructType)):
        return old
    known = {f.name.lower(): f for f in new.fields}
    own = [StructField(f.name, union_type(f.dataType, known[f.name.lower()].dataType) if f.name.lower() in known else f.dataType) for f in old.fields]
    return StructType(own + [f for f in new.fields if f.name.lower() not in {o.name.lower() for o in old.fields}])


def _field(value: Column, kind: StructType, name: str) -> tuple[Column, DataType] | None:
    return next(((value[f.name], f.dataType) for f in kind.fields if f.name.lower() == name.lower()), None)


def _widened(value: Column, have: DataType, want: DataType) -> Column:
    """``value`` with the fields of ``want``, null where it has none."""
    if not isinstance(want, StructType):
        return value.cast(want)
    fields = []
    for f in want.fields:
        found = _field(value, have, f.name)
        fields.append((_widened(*found, f.dataType) if found else F.lit(None).cast(f.dataType)).alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def merged(old: Column, new: Column, old_type: DataType, new_type: DataType) -> Column:
    """The old value with what the new one says."""
    want = union_type(old_type, new_type)
    a, b = _widened(old, old_type, want), _widened(new, new_type, want)
    if isinstance(want, StructType):
        fields = []
        for f in want.fields:
            x, y = _field(old, old_type, f.name), _field(new, new_type, f.name)
            one = merged(x[0], y[0], x[1], y[1]) if x and y else (x or y)[0]
            fields.append(one.cast(f.dataType).alias(f.name))
        return F.when(new.isNull(), a).when(old.isNull(), b).otherwise(F.struct(*fields))
    if isinstance(want, MapType):
        both = F.map_zip_with(a, b, lambda k, x, y: merged(x, y, want.valueType, want.valueType))
        return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(both)
    said = F.when(F.size(b) > 0, b) if isinstance(want, ArrayType) else F.nullif(b, F.lit("")) if isinstance(want, StringType) else b
    return F.coalesce(said, a, b)


def upsert(rows: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """All records after the changes. Several changes of a key count with the last by ``order`` alone (any one of the largest), and without ``order`` the key must be there once."""
    own = changes.where(F.col(key).isNotNull())
    if order is not None:
        own = own.groupBy(key).agg(F.max_by(F.struct(*own.columns), order).alias("_last")).select("_last.*").drop(order)
    whole = lambda df, side: df.select(F.col(key).alias(f"_{side}key"), F.struct(*df.columns).alias(f"_{side}"))
    met = whole(rows, "old").join(whole(own, "new"), F.col("_oldkey") == F.col("_newkey"), "full")
    return met.select(merged(F.col("_old"), F.col("_new"), rows.schema, own.schema).alias("_record")).select("_record.*")
