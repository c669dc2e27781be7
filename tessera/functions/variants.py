"""Fields of several shapes as VARIANT: one parse, reads by path that give null where the shape is another, and JSON back.

A VARIANT keeps its keys sorted; ``written`` puts named keys first in a given order and all others behind, sorted. Characters beyond ASCII stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A place's shapes: its text in one string, or an object.
PLACE_PATHS = {"original": "$.original", "city": "$.parsed.city", "country": "$.parsed.country"}


def parsed(json: Column) -> Column:
    """The document, or null where the text is no JSON."""
    return F.try_parse_json(json)


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null; null for SQL null."""
    shape = F.schema_of_variant(value)
    numbers = shape.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(shape, F.lit("DECIMAL"))
    return (
        F.when(value.isNull(), None)
        .when(F.startswith(shape, F.lit("OBJECT")), "object")
        .when(F.startswith(shape, F.lit("ARRAY")), "array")
        .when(shape == "STRING", "string")
        .when(numbers, "number")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
    )


def text(value: Column, path: str) -> Column:
    """The scalar at a path as a string; null for objects, arrays and what is not there."""
    return F.when(kind(F.try_variant_get(value, path, "variant")).isin("string", "number", "boolean"), F.try_variant_get(value, path, "string"))


def fields(value: Column, path: str, object_paths: Mapping[str, str] = PLACE_PATHS, plain: str = "original") -> Column:
    """Struct of an object's fields; where a string stands in place of the object, that is the field ``plain`` and the others are null."""
    here = F.try_variant_get(value, path, "variant")
    whole = F.when(kind(here) == "string", F.try_variant_get(value, path, "string"))
    return F.struct(*[(F.coalesce(whole, text(here, p)) if name == plain else text(here, p)).alias(name) for name, p in object_paths.items()])


def written(value: Column, first: Sequence[str]) -> Column:
    """JSON text of an object, ``first`` keys in that order and the others sorted; of any other value just its JSON."""
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    rest = F.array_sort(F.filter(F.map_keys(entries), lambda k: ~k.isin(list(first))))
    order = F.concat(F.filter(F.array(*[F.lit(k) for k in first]), lambda k: F.map_contains_key(entries, k)), rest)
    quoted = lambda k: F.to_json(F.to_variant_object(F.array(k)))
    pairs = F.transform(order, lambda k: F.concat(F.regexp_replace(quoted(k), r"^\[|\]$", ""), F.lit(":"), F.to_json(F.coalesce(F.element_at(entries, k), F.parse_json(F.lit("null"))))))
    return F.when(kind(value) == "object", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.to_json(value))
