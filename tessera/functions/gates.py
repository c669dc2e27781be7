"""Gates on a line that was taken for a name: length, part, likeness, and what stands in it and before it.

A line passes one gate after another; the first that turns it away names the reason. A gate may take marks off a line when only
that makes it the name, and later gates see what is left. Likeness is the indel ratio of the upper-cased strings, 0 to 100.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.similarity import indel

#: Marks that go on into the next line, words of descriptions, and ends of lines that a description follows.
MARKS = ":,;.-"
DESCRIPTION_WORDS = ["INSTEAD", "WHEN YOU", "GAIN", "ADD", "HEAL", "DEAL", "COUNT", "ATTACK"]
DESCRIPTION_ENDS = ["STRESS", "WOUND", "DICE", "SUCCESS", "SPACE", "TARGET"]
#: Names whose lines may be over ``LONGEST`` characters.
LONG_NAMES = ["Arcane Mastery"]
LONGEST = 20

Same = Callable[[Column, Column], Column]


def _equal(line: Column, name: Column) -> Column:
    return F.upper(line) == F.upper(name)


def _stripped(text: Column, left: bool = False) -> Column:
    marks = f"[{re.escape(MARKS)}]+"
    return F.trim(F.regexp_replace(text, f"^{marks}" if left else f"{marks}$", ""))


def likeness(line: Column, name: Column) -> Column:
    """What the gates need to know that is computed in Python, once a row: ratio and partial of the line, and of the line without closing marks."""
    bare = _stripped(line)
    kinds = {"ratio": (line, "ratio"), "partial": (line, "partial"), "bare_ratio": (bare, "ratio"), "bare_partial": (bare, "partial")}
    return F.struct(*[indel(text, name, kind).alias(k) for k, (text, kind) in kinds.items()])


def by_fuzz(line: Column, name: Column, like: Column) -> Column:
    """Whether the name was found by likeness and not as it is."""
    return (F.greatest(like["bare_ratio"], like["bare_partial"]) >= 60) & ~_equal(_stripped(line), name)


def length_gate(line: Column, name: Column, like: Column, same: Same = _equal) -> Column:
    """The line as it goes on, null if it is too short for the name."""
    n, fuzzy, short = F.length(line), by_fuzz(line, name, like), F.length(line) * 2 < F.length(name)
    tiny = ~_equal(line, name) & ((n == 2) | ((n < 4) & ~fuzzy))
    trusted = fuzzy | (like["bare_partial"] >= 75)
    bare = _stripped(line)
    plain = F.when(n < 3, None).when((bare != "") & same(bare, name), bare).when(like["ratio"] >= 60, line)
    return F.when(tiny, None).when(~short, line).when(trusted, F.when((like["partial"] >= 75) | (n >= 3), line)).otherwise(plain)


def is_part(line: Column, name: Column, like: Column) -> Column:
    """Whether the line is too long for the name or only a part of it.

    A line with the second word of a name is none, even if the first is lost.
    """
    up, words = F.upper(line), F.split(F.upper(F.trim(name)), r"\s+")
    start = lambda i: F.substring(F.get(words, F.lit(i)), 1, 2)
    several, missing = F.size(words) > 1, F.length(name) - F.length(line)
    lost = F.when(several, (F.trim(up) != "") & ~F.contains(up, start(0))).otherwise((missing >= 2) & ~F.contains(up, start(0)) & (like["ratio"] < 85))
    return F.when(missing < -10, True).when(several & F.contains(up, start(1)), False).otherwise((missing > 3) | lost)


def part_gate(line: Column, name: Column, like: Column, fuzzy: Column, same: Same = _equal) -> Column:
    """The line as it goes on, null if it is only a part of the name; names found by likeness pass."""
    bare = _stripped(line, left=True)
    return F.when(fuzzy | ~is_part(line, name, like), line).when((bare != "") & same(bare, name), bare)


def alike(line: Column, name: Column, like: Column) -> Column:
    """Equal, or of a likeness of 75, or of 60 at nearly the same length."""
    longer = F.length(line) - F.length(name)
    return _equal(line, name) | ((longer <= 5) & ((like["ratio"] >= 75) | ((like["ratio"] >= 60) & (longer >= -5))))


def describes(line: Column, previous: Column) -> Column:
    """Whether the line speaks of an effect, or a long line before it ends as if one went on."""
    speaks = F.upper(line).rlike("|".join(DESCRIPTION_WORDS))
    goes_on = (F.length(previous) > 50) & F.upper(previous).rlike(f"({'|'.join(DESCRIPTION_ENDS)})$")
    return speaks | F.coalesce(goes_on, F.lit(False))


def verdict(line: Column, name: Column, previous: Column, like: Column, same: Same = _equal, long_names: Sequence[str] = LONG_NAMES) -> Column:
    """Name of the gate that turns the line away (long, short, part, unlike, description); "accepted" if none does; null for a null line or name."""
    line, previous = F.trim(line), F.trim(previous)
    fuzzy = by_fuzz(line, name, like)
    after_length = length_gate(line, name, like, same)
    after_part = part_gate(after_length, name, like, fuzzy, same)
    # a line that lost its marks is the name, whatever the likeness of the line before
    good = fuzzy | (after_part != line) | alike(after_part, name, like)
    return (
        F.when(line.isNull() | name.isNull(), None)
        .when((F.length(line) > LONGEST) & ~name.isin(list(long_names)), "long")
        .when(after_length.isNull(), "short")
        .when(after_part.isNull(), "part")
        .when(~good, "unlike")
        .when(~_equal(after_part, name) & describes(after_part, previous), "description")
        .otherwise("accepted")
    )
