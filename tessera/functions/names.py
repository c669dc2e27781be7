"""Names, references, mottoes and generated sentences, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.facts import ANY
from tessera.functions.scoring import let

#: Titles that are no part of a name, for keys of tables and for whole names.
KEY_TITLES = r"(?i)^(lord|professor|sergeant|dr\.|dr)\s+"
NAME_TITLES = r"(?i)^(lord|lady|sir|dame|dr\.?|doctor|professor|prof\.?|sergeant|sgt\.?|captain|capt\.?|lieutenant|lt\.?)\s+"
#: Fixed value: a name and its number.
REFERENCE = r"([A-Z][a-zA-Z\s'\-\.]+?)\s*\((\d+)\)"
#: Fixed value: what stands for an effect without figures.
NO_EFFECT = "Other effect (no dice, elder sign conversion, or actions)"
#: Corrections of mottoes, in order: those before what stands in front of a quote goes, and those after.
MOTTO_ENDS = [
    (r"^[-|~_\s]+", ""),
    (r"[-|~_\s]+$", ""),
    (r"\s*[|~_]\s*", " "),
    (r"^[-|\s~_id0-9]+\s*[\"']", '"'),
]
MOTTO_RULES = [
    (r"qT\.", "is"),
    ("wriften|writen|writtn", "written"),
    (r"([\"'“”])4 ", "$1I "),
    (r"(^|\s)4\s+", "$1I "),
    (r"\bInstead\.\s+", "Instead, "),
    (r"(?i)\binstead,?\s+make\b", "Instead, I make"),
    (r"\b(\w+)\s+\1\b", "$1"),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"\s+\w{1,2}$", ""),
]
#: Fixed value: so many characters in front of a quote, or more, are no garbage.
MOTTO_LEAD = 15


def _words(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def effect_sentence(green: Column, black: Column, conversion: Column, factor: Column, actions: Column, kind: Column) -> Column:
    """What an effect does, as sentences made of its figures; a fixed sentence where it has none."""
    dice = F.concat_ws(" + ", F.when(green > 0, _words(green, " green dice")), F.when(black > 0, _words(black, " black dice")))
    counted = F.when(conversion >= ANY, "any elder signs as ").otherwise(_words(conversion, " elder sign(s) as "))
    worth = F.when(factor > 1, _words(factor, " successes each")).when(conversion >= ANY, "successes").otherwise("success(es)")
    many = F.when(actions == 1, kind).when(F.endswith(kind, F.lit("s")), kind).otherwise(_words(kind, "s"))
    parts = F.concat_ws(
        ". ",
        F.when(dice != "", _words("Adds ", dice)),
        F.when(conversion > 0, _words("Counts ", counted, worth)),
        F.when(actions > 0, _words("Adds ", actions, " free ", many, " per turn")),
    )
    return F.when(parts == "", NO_EFFECT).otherwise(parts)


def name_key(name: Column) -> Column:
    """Key of assignment tables: without number and title, the first word in lower case."""
    plain = F.regexp_replace(F.regexp_replace(name, r"\s*\(\d+\)", ""), KEY_TITLES, "")
    return F.lower(F.regexp_extract(plain, r"^\s*(\S*)", 1))


def plain_name(name: Column) -> Column:
    """Lower case, without title and marks, single spaces."""
    return F.lower(F.trim(rules.patterns(name, [(NAME_TITLES, ""), (r"[^\w\s]", ""), (r"\s+", " ")])))


def references(text: Column) -> Column:
    """Array of (name, number) of the comma parts that read "Name (number)"; the first such name of a part counts."""
    found = F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.regexp_extract(p, REFERENCE, 1)).alias("name"), F.nullif(F.regexp_extract(p, REFERENCE, 2), F.lit("")).try_cast("int").alias("number")))
    return F.filter(found, lambda r: r["number"].isNotNull())


def clean_motto(motto: Column) -> Column:
    """A motto without separators, garbage, what stands in front of its first quote, doubled words and a cut last word; null stays null.

    The first double quote counts, without one the first single quote; a longer piece in front of it stays.
    """

    def from_quote(t: Column) -> Column:
        double = F.instr(t, '"')
        at = F.when(double > 0, double).otherwise(F.instr(t, "'"))
        return F.when(at.between(2, MOTTO_LEAD), F.substring(t, at, F.length(t))).otherwise(t)

    return rules.patterns(let(rules.patterns(motto, MOTTO_ENDS), from_quote), MOTTO_RULES)


def valid_extraction(text: Column) -> Column:
    """Over five characters, over a fifth of them letters, and no placeholder; false for null."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.coalesce((F.length(text) > 5) & (letters * 5 > F.length(text)) & ~F.contains(text, F.lit("Not found")), F.lit(False))
