"""Labelled summaries of a level's statistics, stamps of dates, and simple predicates on lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def improvements(conditions: Column, rerolls: Column, reroll_kind: Column, wounds: Column, stress: Column, less_wounds: Column, less_sanity: Column) -> Column:
    """Up to four strings: conditions, rerolls, healing and reduction, where there are any."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    some = lambda a, b: (F.coalesce(a, F.lit(0)) > 0) | (F.coalesce(b, F.lit(0)) > 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.array_compact(
        F.array(
            F.when(F.size(conditions) > 0, text("Conditional: ", F.array_join(conditions, ", "))),
            F.when(F.coalesce(rerolls, F.lit(0)) > 0, text("Rerolls: ", zero(rerolls), " (", reroll_kind, ")")),
            F.when(some(wounds, stress), text("Healing: ", zero(wounds), " wounds, ", zero(stress), " stress")),
            F.when(some(less_wounds, less_sanity), text("Defensive: ", zero(less_wounds), " wounds, ", zero(less_sanity), " sanity")),
        )
    )


def is_description(line: Column, keywords: Sequence[str], longest: int = 60) -> Column:
    """Whether a line is too long for a name or holds one of the words of descriptions, given in capitals."""
    held = F.lit(False)
    for word in keywords:
        held |= F.contains(F.upper(line), F.lit(word))
    return (F.length(F.trim(line)) > longest) | held


def without_capitals(text: Column, least: int = 6) -> Column:
    """Text without words of ``least`` and more capitals behind its first word, and with a full stop if it is long and ends in a letter."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, rf"\s+[A-Z]{{{least},}}\b", ""), r"\s+", " "))
    return F.when((F.length(clean) > 20) & clean.rlike("[A-Za-z]$"), F.concat(clean, F.lit("."))).otherwise(clean)


def date_part(stamp: Column) -> Column:
    """The date of an ISO timestamp, as a string."""
    return F.split(stamp, "T")[0]


def file_stamp(moment: Column) -> Column:
    """A moment as it stands in file names; the caller gives the moment, so that runs can be repeated."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def upgrades() -> Column:
    """Recommended upgrades of a build: none are made, as a typed empty list."""
    return F.array().cast("array<string>")
