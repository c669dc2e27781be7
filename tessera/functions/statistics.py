"""The statistics of a power's level out of its description, and what is asked of powers as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dice, facts
from tessera.functions.scoring import let

#: Fixed value: levels of a whole power.
LEVELS = 4
LEVEL = "struct<level:int,description:string>"


def level_statistics(description: Column) -> Column:
    """Struct of the twenty statistics of a level; null for a null description.

    Successes and risks have three places and percents two, rounded to even on ties. A text with no effect leaves the base roll as it is.
    """
    found = F.struct(
        facts.green_dice(description).alias("green"), facts.black_dice(description).alias("black"), facts.conversion(description).alias("conversion"), facts.conversion_factor(description).alias("factor"),
        facts.conditions(description).alias("conditions"), facts.rerolls(description).alias("rerolls"), facts.reroll_kind(description).alias("reroll_kind"), facts.wounds_healed(description).alias("wounds"),
        facts.stress_healed(description).alias("stress"), facts.wound_reduction(description).alias("less_wounds"), facts.sanity_reduction(description).alias("less_sanity"),
    )
    # bound to a name, so that a text is searched once for a fact, however many figures follow from it
    return F.when(description.isNotNull(), let(found, _figures))


def _figures(found: Column) -> Column:
    green, black = found["green"], found["black"]
    enhanced, increase, percent, most, risk, _ = dice.impact(green, black, found["conversion"], found["factor"])
    base = lambda symbol: F.bround(dice.expected(F.lit(dice.BASE_BLACK), F.lit(dice.BASE_GREEN), symbol), 3)
    named = {
        "green_dice_added": green,
        "black_dice_added": black,
        "base_expected_successes": base("success"),
        "enhanced_expected_successes": F.bround(enhanced, 3),
        "expected_successes_increase": F.bround(increase, 3),
        "expected_successes_percent_increase": F.bround(percent, 2),
        "max_successes_increase": most.cast("int"),
        "tentacle_risk": F.bround(risk, 3),
        "base_tentacle_risk": base("tentacle"),
        "is_conditional": F.size(found["conditions"]) > 0,
        "conditions": found["conditions"],
        "rerolls_added": found["rerolls"],
        "reroll_type": found["reroll_kind"],
        "has_reroll": found["rerolls"] > 0,
        "wounds_healed": found["wounds"],
        "stress_healed": found["stress"],
        "has_healing": (found["wounds"] > 0) | (found["stress"] > 0),
        "wound_reduction": found["less_wounds"],
        "sanity_reduction": found["less_sanity"],
        "has_defensive": (found["less_wounds"] > 0) | (found["less_sanity"] > 0),
    }
    return F.struct(*[c.alias(k) for k, c in named.items()])


def improves(statistics: Column) -> Column:
    """Whether a level does anything beyond its dice."""
    return statistics["is_conditional"] | statistics["has_reroll"] | statistics["has_healing"] | statistics["has_defensive"]


def with_level(levels: Column, number: Column, description: Column) -> Column:
    """The levels and one more, its text trimmed; null levels are none. A number outside one to four leaves them as they are."""
    have = F.coalesce(levels, F.array().cast(f"array<{LEVEL}>"))
    added = F.struct(number.cast("int").alias("level"), F.regexp_replace(description, r"^\s+|\s+$", "").alias("description"))
    return F.when(number.between(1, LEVELS) & description.isNotNull(), F.array_append(have, added)).otherwise(have)


def has_levels(levels: Column) -> Column:
    return F.coalesce(F.size(levels) > 0, F.lit(False))


def is_complete(levels: Column) -> Column:
    return F.coalesce(F.size(levels) >= LEVELS, F.lit(False))


def has_power(powers: Column, name: Column) -> Column:
    """Whether a name is among an entity's powers, as it is written; false for a null list or name."""
    return F.coalesce(F.array_contains(powers, name), F.lit(False))
