"""Ordered rewrite rules as one Column. The order of a table is its meaning: rules see what earlier rules left."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered literal corrections of misread words and marks.
LITERAL_CORRECTIONS = [
    ("freee", "free"),
    ("detectitve", "detective"),
    ("figuresures", "figures"),
    ("railing", "rolling"),
    ("aff", "and"),
    ("BINS", "When"),
    ("I enemy", "1 enemy"),
    ("wou", "wound"),
    ("o!", "of"),
    ("re bce", "reduce"),
    ("rero", "reroll"),
    ("santiy", "sanity"),
    ("goin", "gain"),
    ("ison", "is on"),
    ("isone", "is on"),
    ("doesnt", "doesn't"),
    ("Goin", "Gain"),
    ("Isone", "Is on"),
    ("Is on", "Is on"),
    ("Yi", "elder signs"),
    ("Yx-", "elder signs"),
    ("|", " "),
    ("~", " "),
    ("—", "-"),
    ("–", "-"),
]

#: Nouns before which a lone capital I is a misread 1.
COUNTED_NOUNS = ["enemy", "space", "free", "additional", "green", "black", "elder", "success", "attack", "action", "reroll", "stress", "wound", "times", "die", "dice"]

#: Substrings that speak of an effect.
EFFECT_WORDS = ["gain", "add", "count", "may", "when", "instead", "also", "per turn", "free", "attack", "dice", "success", "elder sign", "tentacle", "sanity", "stress", "wound"]

#: Key phrases by topic.
KEY_PHRASES = {
    "dice": ["green dice", "black dice", "dice"],
    "elder_sign": ["elder sign", "arcane", "elder signs"],
    "success": ["success", "succeed", "successes"],
    "attack": ["attack", "attacking"],
    "action": ["action", "actions"],
    "reroll": ["reroll", "rerolls"],
    "sneak": ["sneak", "sneaking"],
    "heal": ["heal", "healing"],
    "wound": ["wound", "wounds"],
    "stress": ["stress"],
}


def literal(text: Column, rules: Sequence[tuple[str, str]] = LITERAL_CORRECTIONS) -> Column:
    """Case-sensitive substring rewrites, in order, without regard to word bounds."""
    return reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def bounded(text: Column, rules: Sequence[tuple[str, str]] = LITERAL_CORRECTIONS) -> Column:
    """The same rewrites of whole words only, ignoring case."""
    return reduce(lambda c, rule: F.regexp_replace(c, rf"(?i)\b{re.escape(rule[0])}\b", rule[1]), rules, text)


def patterns(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression rewrites, in order."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text)


def digit_context(text: Column) -> Column:
    """A lone capital I before a counted noun becomes 1."""
    found = patterns(text, [(rf"\bI\s+{noun}\b", f"1 {noun}") for noun in COUNTED_NOUNS[:4]])
    return patterns(F.regexp_replace(found, r"\bI\s+woun", "1 wound"), [(rf"\bI\s+{noun}\b", f"1 {noun}") for noun in COUNTED_NOUNS[4:]])
