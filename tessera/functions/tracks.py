"""Tracks of a character's state, in closed form for one event and as folds over ordered events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slots of the insanity track that stop it, those of them that give a die (by place), and its end.
SWIRLS = [5, 9, 13, 16, 19, 20]
DICE_SWIRLS = [2, 4, 5, 6]
DEATH = 21
#: Damage that a health track holds, health points, stress that a stress track holds, points of a rest.
DAMAGE_LIMIT, HEALTH, STRESS_LIMIT, REST_POINTS = 6, 5, 5, 3


def swirls_reached(insanity: Column) -> Column:
    return sum(((insanity >= s).cast("int") for s in SWIRLS), F.lit(0))


def bonus_dice(insanity: Column) -> Column:
    return sum(((insanity >= SWIRLS[i - 1]).cast("int") for i in DICE_SWIRLS), F.lit(0))


def next_swirl(insanity: Column) -> Column:
    """The next slot that stops the track; null past the last."""
    return F.coalesce(*[F.when(insanity < s, s) for s in SWIRLS])


def advance(insanity: Column, tentacles: Column, stop: bool = True) -> Column:
    """Insanity after some tentacles: not past the next swirl where one is reached, nor past the end."""
    end = F.coalesce(next_swirl(insanity), F.lit(DEATH)) if stop else F.lit(DEATH)
    return F.least(insanity + tentacles, end, F.lit(DEATH))


def insanity_columns(insanity: Column) -> list[Column]:
    return [
        (insanity >= DEATH).alias("dead"),
        F.greatest(F.lit(0), F.lit(DEATH) - insanity).alias("until_death"),
        swirls_reached(insanity).alias("swirls"),
        (F.lit(len(SWIRLS)) - swirls_reached(insanity)).alias("levels_left"),
        bonus_dice(insanity).alias("bonus_dice"),
        next_swirl(insanity).alias("next_swirl"),
        (next_swirl(insanity) - insanity).alias("until_swirl"),
    ]


def fold_insanity(steps: Column, start: int = 0) -> Column:
    """Insanity after an ordered array of tentacle counts, stopping at swirls."""
    return F.aggregate(steps, F.lit(start), lambda at, n: advance(at, n.cast("int")))


def damage(before: Column, taken: Column) -> Column:
    return F.least(F.lit(DAMAGE_LIMIT), before + taken)


def heal(before: Column, healed: Column) -> Column:
    return F.greatest(F.lit(0), before - healed)


def health(damaged: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(HEALTH) - damaged)


def stress(before: Column, taken: Column) -> Column:
    return F.least(F.lit(STRESS_LIMIT), before + taken)


def rest(health_asked: Column, stress_asked: Column, points: int = REST_POINTS) -> tuple[Column, Column]:
    """Points of a rest for health and stress; more than there are is scaled down and cut to whole points."""
    total = health_asked + stress_asked
    scaled = lambda part: F.when(total > points, (part * (F.lit(float(points)) / total)).cast("int")).otherwise(part)
    return scaled(health_asked), scaled(stress_asked)


def playstyle(successes: Column, tentacles: Column, wounds_healed: Column, stress_healed: Column, rerolls: Column) -> Column:
    """First rule that holds: offensive, defensive, utility, balanced."""
    return F.when((successes > 2.5) & (tentacles < 1.0), "offensive").when((wounds_healed > 0) | (stress_healed > 0), "defensive").when(rerolls > 0, "utility").otherwise("balanced")


def strengths(successes: Column, tentacles: Column, green: Column, wounds_healed: Column, stress_healed: Column, rerolls: Column, converted: Column) -> Column:
    """Labels of what a build does well, in a fixed order."""
    rules = [(successes > 2.0, "High success rate"), (tentacles < 1.0, "Low tentacle risk"), (green > 0, "Green dice bonuses (safer rolls)"), (wounds_healed > 0, "Wound healing"), (stress_healed > 0, "Stress healing"), (rerolls > 0, "Reroll capabilities"), (converted > 0, "Elder sign conversion")]
    return F.array_compact(F.array(*[F.when(rule, label) for rule, label in rules]))


def weaknesses(successes: Column, tentacles: Column, green: Column, wounds_healed: Column, stress_healed: Column, rerolls: Column) -> Column:
    rules = [(successes < 1.5, "Low success rate"), (tentacles > 1.5, "High tentacle risk"), (green == 0, "No green dice (higher tentacle risk)"), ((wounds_healed == 0) & (stress_healed == 0), "No healing capabilities"), (rerolls == 0, "No reroll capabilities")]
    return F.array_compact(F.array(*[F.when(rule, label) for rule, label in rules]))
