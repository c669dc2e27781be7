"""Quality issues, completeness and weighted scores as Column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.similarity import ratio

#: Weights of an entity's parts (they add up to 9.5 of 10), and of the parts of an overall score.
ENTITY_WEIGHTS = {"name": 1.0, "motto": 0.5, "story": 1.0, "place": 0.5, "city": 0.5, "special_power": 1.0, "common_powers": 1.0, "front_image": 1.0, "back_image": 1.0, "audio": 1.0, "encyclopedia": 0.5, "second_encyclopedia": 0.5}
OVERALL_WEIGHTS = {"name": 0.10, "place": 0.10, "motto": 0.10, "story": 0.15, "power": 0.30, "dice": 0.10, "mechanics": 0.15}
#: Points for words that speak of mechanics.
MECHANICS = {"gain": 10, "add": 10, "instead": 15, "heal": 10, "healing": 10, "reroll": 10, "attack": 10, "action": 10, "dice": 5}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside other functions' lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def frequent_words(text: Column, over: int = 3, longer: int = 3) -> Column:
    """Words of more than ``longer`` characters that stand more than ``over`` times, in order of first appearance.

    A word's count is read from the words sorted, so that the work grows with n log n.
    """

    def repeated(words: Column) -> Column:
        often = let(F.array_sort(words), lambda s: F.filter(s, lambda w, i: (i >= over) & (F.get(s, i - over) == w)))
        return F.array_intersect(F.array_distinct(words), often)

    return let(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > longer), repeated)


def description_issues(text: Column) -> Column:
    """Names of what is wrong with a description, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(text.rlike("[A-Z]{5,}"), "capitals"),
            F.when(text.rlike(r"\s{3,}"), "whitespace"),
            F.when((F.length(text) > 20) & ~text.rlike(r"[.!?]$"), "unfinished"),
            F.when(F.contains(text, F.lit("Not found")) | F.contains(text, F.lit("TODO")), "placeholder"),
            F.when(F.length(text) < 20, "short"),
            F.when(F.size(frequent_words(text)) > 0, "repeated"),
        )
    )


def validity_doubts(text: Column) -> dict[str, Column]:
    """Each reason to doubt a description by itself, whatever the others say; all are null for a null text. White space is that of ASCII without the vertical tab."""
    return {
        "too short": F.length(text) < 5,
        "long": F.length(text) > 500,
        "bars": text.rlike("[|]{2,}"),
        "tildes": text.rlike("[~]{2,}"),
        "characters": text.rlike(r"[^\w \t\n\f\r.,;:!?\-()\[\]/]{3,}"),
    }


def validity_issues(text: Column) -> Column:
    """Reasons to doubt a description; a null text, or one that is under five characters once trimmed, has that one reason only."""
    doubts = validity_doubts(text)
    rest = F.array_compact(F.array(*(F.when(doubts[x], x) for x in ("long", "bars", "tildes", "characters"))))
    return F.when(text.isNull() | (F.length(F.trim(text)) < 5), F.array(F.lit("too short"))).otherwise(rest)


def present(value: Column) -> Column:
    """Neither null nor an empty string."""
    return F.coalesce(value.cast("string"), F.lit("")) != ""


def weighted_presence(flags: Mapping[str, Column], weights: Mapping[str, float] = ENTITY_WEIGHTS, out_of: float = 10.0) -> Column:
    """Share of the weights whose part is there, at most 1."""
    total = sum((F.when(flags[k], w).otherwise(0.0) for k, w in weights.items() if k in flags), F.lit(0.0))
    return F.least(total / out_of, F.lit(1.0))


def season_completeness(data: Column, audio: Column, images: Column, members: Column) -> Column:
    """0.4, 0.3 and 0.3 of the shares of members that have each, to two places; 0 without members."""
    return F.when(members > 0, F.round((data * 0.4 + audio * 0.3 + images * 0.3) / members, 2)).otherwise(0.0)


def parse_score(name: Column, place: Column, motto: Column, story: Column, power: Column, power_complete: Column, powers: Column, issues: Column) -> Column:
    """100 less a penalty for each missing part and 15 for each issue; not under 0."""
    off = F.when(~present(name) | (name == "Unknown"), 20).otherwise(0)
    for part, points in ((place, 15), (motto, 15), (story, 20)):
        off = off + F.when(~present(part), points).otherwise(0)
    off = off + F.when(~power, 15).when(~power_complete, 10).otherwise(0) + F.when(powers == 0, 15).when(powers != 2, 10).otherwise(0)
    return F.greatest(F.lit(0.0), F.lit(100.0) - off - issues * 15)


def mechanics_score(text: Column) -> Column:
    """Points for mechanics words and five for each number up to 15, at most 100."""
    low = F.lower(text)
    words = sum((F.when(F.contains(low, F.lit(w)), p).otherwise(0) for w, p in MECHANICS.items()), F.lit(0))
    numbers = F.least(F.size(F.regexp_extract_all(low, F.lit(r"(\b\d+\b)"))) * 5, F.lit(15))
    return F.least(words + numbers, F.lit(100))


def near(text: Column, first: str, second: str, within: int = 50) -> Column:
    """Whether the first places of two words are less than ``within`` characters apart; false if one is missing."""
    a, b = F.locate(first, F.lower(text)), F.locate(second, F.lower(text))
    return (a > 0) & (b > 0) & (F.abs(a - b) < within)


def text_score(found: Column, truth: Column) -> Column:
    """Similarity times 100; 50 without a truth, 0 without a find."""
    return F.when(~present(truth), 50.0).when(~present(found), 0.0).when(F.lower(F.trim(found)) == F.lower(truth), 100.0).otherwise(ratio(found, truth) * 100)


def place_score(found: Column, truth: Column) -> Column:
    """As text_score, but 80 where a comma part is shared; parts are compared with their spaces."""
    shared = F.arrays_overlap(F.split(F.lower(found), ","), F.split(F.lower(truth), ","))
    return F.when(~present(truth), 50.0).when(~present(found), 0.0).when(F.lower(F.trim(found)) == F.lower(truth), 100.0).when(shared, 80.0).otherwise(ratio(found, truth) * 100)


def motto_score(found: Column, truth: Column) -> Column:
    """The better of similarity times 100 and 80 times the share of the truth's words that were found; quotes do not count."""
    f, t = (F.regexp_replace(F.trim(c), "[\"']", "") for c in (found, truth))
    words_f, words_t = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (f, t))
    recall = F.when((F.size(words_t) > 0) & (F.size(words_f) > 0), F.size(F.array_intersect(words_f, words_t)) / F.size(words_t) * 80).otherwise(0.0)
    return F.when(~present(truth), 50.0).when(~present(found), 0.0).when(F.lower(f) == F.lower(t), 100.0).otherwise(F.greatest(ratio(f, t) * 100, recall))


def overall(scores: Mapping[str, Column], weights: Mapping[str, float] = OVERALL_WEIGHTS) -> Column:
    return sum((scores[k] * w for k, w in weights.items()), F.lit(0.0))
