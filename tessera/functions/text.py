"""Cleaning, splitting and validating short texts, as Column functions.

ASCII character classes are used throughout, so that results equal those of other SQL engines; ``unicode=True`` asks
for Unicode letters and spaces instead where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules


def dice_symbols(text: Column) -> Column:
    """Glyphs and spellings of the two dice to "green dice" and "black dice"."""
    return rules.patterns(text, [("[●○◉🟢🟩]", "green dice"), (r"(?i)green\s*dice", "green dice"), ("[■□⬛⬜]", "black dice"), (r"(?i)black\s*dice", "black dice")])


def threshold_symbols(text: Column) -> Column:
    """Glyph and phrases of the threshold to "red swirl"; the phrase without "in" comes first, so "in" may stay in front."""
    return rules.patterns(text, [("🌀", "red swirl"), (r"(?i)red\s*swirl", "red swirl"), (r"(?i)sanity\s*threshold", "red swirl"), (r"(?i)insanity\s*threshold", "red swirl"), (r"(?i)red\s*sanity\s*marker", "red swirl")])


def whitespace(text: Column, keep_lines: bool = False) -> Column:
    """White space to single spaces, trimmed; or line by line, with the line breaks kept."""
    if not keep_lines:
        return F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ | $", "")


def artifacts(text: Column, keep_symbols: bool = True, unicode: bool = False) -> Column:
    """Bars and tildes to a space, then everything but words, spaces, plain punctuation and (if wanted) dice glyphs away."""
    flag = "(?U)" if unicode else ""
    bars = rules.patterns(text, [(rf"{flag}\s*[|]\s*", " "), (rf"{flag}\s*[~]\s*", " ")])
    return F.regexp_replace(bars, rf"{flag}[^\w\s.,;:!?\-()\[\]/{'●○◉🌀■□⬛⬜' if keep_symbols else ''}]", "")


def clean(text: Column, keep_lines: bool = False, keep_symbols: bool = True, dice: bool = True, threshold: bool = True) -> Column:
    """Literal corrections, symbols, white space and artifacts, in that order."""
    out = rules.literal(text)
    out = dice_symbols(out) if dice else out
    out = threshold_symbols(out) if threshold else out
    return F.trim(artifacts(whitespace(out, keep_lines), keep_symbols))


def letter_substitutions(text: Column) -> Column:
    """Digits between letters to the letters they stand for; number and percent signs away."""
    pairs = [("0", "O"), ("1", "I"), ("5", "S"), ("8", "B"), ("6", "G"), (r"\|", "I"), ("@", "a")]
    return rules.patterns(text, [("[#%]", ""), *[(rf"([a-zA-Z]){a}([a-zA-Z]|\b)", f"$1{b}$2") for a, b in pairs]])


def collapse_repeats(text: Column) -> Column:
    """A phrase of one to five words that stands twice in a row, once; three passes."""
    return rules.patterns(text, [(r"(?i)\b(\w+(?:\s+\w+){0,4})\s+\1\b", "$1")] * 3)


def word_boundaries(text: Column) -> Column:
    """A space between a small and a capital letter, then white space collapsed."""
    return whitespace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))


def sentences(text: Column) -> Column:
    """Trimmed sentences without closing marks; empty ones dropped."""
    parts = F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.regexp_replace(F.trim(s), r"[.!?]+$", ""))
    return F.filter(parts, lambda s: F.trim(s) != "")


def integers(text: Column) -> Column:
    """All runs of digits, as longs (null where too long for one)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)")), lambda s: s.try_cast("long"))


def level_number(text: Column) -> Column:
    """The number of a "Level n", "Lv n", "n:" or leading "n." mark, in that order of preference."""
    found = [F.regexp_extract(text, p, 1) for p in (r"(?i)level\s*(\d+)", r"(?i)lv\.?\s*(\d+)", r"(\d+)\s*:", r"^\s*(\d+)\.")]
    return F.coalesce(*[F.nullif(f, F.lit("")).try_cast("int") for f in found])


def likely_effect(text: Column, least: int = 20) -> Column:
    """Long enough, with two effect words or more."""
    hits = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in rules.EFFECT_WORDS), F.lit(0))
    return (F.length(text) >= least) & (hits >= 2)


def phrase_flags(text: Column) -> dict[str, Column]:
    """For each topic, whether one of its key phrases stands in the text."""
    return {topic: F.lower(text).rlike("|".join(words)) for topic, words in rules.KEY_PHRASES.items()}


def slug(text: Column) -> Column:
    """Lower case, only word characters, separators to single hyphens."""
    plain = F.regexp_replace(F.lower(text), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s_-]+", "-"), "^-+|-+$", "")


def display_name(identifier: Column) -> Column:
    """"season3" to "Season 3"; words with hyphens to capitalised words."""
    return F.when(F.startswith(identifier, F.lit("season")), F.concat(F.lit("Season "), F.replace(identifier, F.lit("season"), F.lit("")))).otherwise(F.initcap(F.replace(identifier, F.lit("-"), F.lit(" "))))


def header_line(line: Column) -> Column:
    """All capitals of 4 to 99 characters, or several words that each begin with a capital."""
    capitals = line.rlike("[A-Z]") & (line == F.upper(line)) & F.length(line).between(4, 99)
    return capitals | line.rlike(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)+$")


def narration(name: Column, place: Column, story: Column) -> Column:
    """What there is of name, place and story, as sentences; null if there is nothing."""
    parts = F.concat_ws(". ", F.nullif(name, F.lit("")), F.nullif(place, F.lit("")), F.nullif(story, F.lit("")))
    return F.when(parts != "", F.concat(parts, F.lit(".")))


def shortened(text: Column, most: int = 200) -> Column:
    """The first characters and an ellipsis, where there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
