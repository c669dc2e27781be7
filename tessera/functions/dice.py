"""Closed-form probabilities of rolls of two kinds of dice, as columns.

``mode="reference"`` counts a face that shows two symbols once for the symbol and once more for the combination, as the established
figures do (half of all black faces carry a tentacle, half of all green ones a sign); ``mode="faces"`` counts
each face once. Successes are the same in both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six faces of each die.
FACES = {
    "black": [["success"], ["tentacle"], ["success", "tentacle"], ["success"], ["elder_sign"], ["blank"]],
    "green": [["blank"], ["blank"], ["elder_sign"], ["success"], ["success"], ["elder_sign", "success"]],
}
#: Base roll of a turn.
BASE_BLACK, BASE_GREEN = 3, 0


@dataclass(frozen=True)
class Chances:
    success: float
    tentacle: float
    elder_sign: float
    blank: float


def chances(die: str, mode: str = "reference") -> Chances:
    """Chance of each symbol on one die."""
    if mode not in ("reference", "faces"):
        raise ValueError(f"unknown mode {mode!r}")
    share = {s: sum(s in face for face in FACES[die]) / 6 for s in ("success", "tentacle", "elder_sign", "blank")}
    if mode == "reference":
        for s in ("tentacle", "elder_sign"):
            share[s] += sum(s in face and len(face) > 1 for face in FACES[die]) / 6
    return Chances(**share)


def faces(spark: SparkSession) -> DataFrame:
    """die, face, symbols, p: one row per face."""
    rows = [(die, i + 1, face, 1 / 6) for die, every in FACES.items() for i, face in enumerate(every)]
    return spark.createDataFrame(rows, "die string, face int, symbols array<string>, p double")


def histogram(table: DataFrame) -> DataFrame:
    """die, symbol, p: chance of each symbol, and of each combination of symbols under their joined names."""
    single = table.select("die", F.explode("symbols").alias("symbol"), "p")
    combined = table.where(F.size("symbols") > 1).select("die", F.array_join(F.array_sort("symbols"), "+").alias("symbol"), "p")
    return single.union(combined).groupBy("die", "symbol").agg(F.sum("p").alias("p"))


def expected(black: Column, green: Column, symbol: str, mode: str = "reference") -> Column:
    b, g = getattr(chances("black", mode), symbol), getattr(chances("green", mode), symbol)
    return black * F.lit(b) + green * F.lit(g)


def at_least_one(black: Column, green: Column, symbol: str, mode: str = "reference") -> Column:
    """Chance that some die shows the symbol; dice are independent."""
    b, g = getattr(chances("black", mode), symbol), getattr(chances("green", mode), symbol)
    return F.lit(1.0) - F.pow(F.lit(1 - b), black) * F.pow(F.lit(1 - g), green)


def roll(black: Column, green: Column, mode: str = "reference") -> list[Column]:
    """Figures of one roll as named columns."""
    out = [(black + green).alias("dice"), (black + green).alias("max_successes")]
    for symbol, name in (("success", "successes"), ("tentacle", "tentacles"), ("elder_sign", "elder_signs")):
        out.append(expected(black, green, symbol, mode).alias(f"expected_{name}"))
        out.append(at_least_one(black, green, symbol, mode).alias(f"any_{symbol}"))
    return out


def percent_increase(before: Column, after: Column) -> Column:
    """Growth in percent; 0 from nothing."""
    return F.when(before > 0, (after - before) / before * 100).otherwise(0.0)


def impact(green: Column, black: Column, conversion: Column, factor: Column, any_number: int = 999, mode: str = "reference") -> list[Column]:
    """What an effect adds to the base roll: enhanced successes, increase, percent, largest increase, risk.

    A conversion turns up to its number of the expected elder signs into ``factor`` successes each.
    """
    dice_black, dice_green = F.lit(BASE_BLACK) + black, F.lit(BASE_GREEN) + green
    base = expected(F.lit(BASE_BLACK), F.lit(BASE_GREEN), "success", mode)
    signs = expected(dice_black, dice_green, "elder_sign", mode)
    bonus = F.when(conversion >= any_number, signs * factor).otherwise(F.least(signs, conversion.cast("double")) * factor)
    enhanced = expected(dice_black, dice_green, "success", mode) + bonus
    percent = percent_increase(base, enhanced)
    return [enhanced.alias("enhanced"), (enhanced - base).alias("increase"), percent.alias("percent"), (black + green).alias("max_increase"), expected(dice_black, dice_green, "tentacle", mode).alias("risk"), (percent > 10).alias("significant")]


def summary(black: Column, green: Column) -> Column:
    """A line of text about a roll."""
    return F.format_string("%d black + %d green: %.2f successes, %.2f tentacles", black.cast("int"), green.cast("int"), expected(black, green, "success"), expected(black, green, "tentacle"))
