"""Named chains of text functions, chosen row by row by a name in the data, with a fallback for names that nobody registered.

Each row runs its own chain alone. A row whose Python step fails has the text "" and the failure in ``error``; the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import cards, rules, text

Step = Callable[[Column], Column]

#: Ordered corrections of the three levels, all but the last table ignoring case.
BASIC = [
    (r"\bgoin\b", "gain"),
    (r"\bgoin g\b", "gaining"),
    (r"\bsantiy\b", "sanity"),
    (r"\bwoundndnds\b", "wounds"),
    (r"\bwoundnds\b", "wounds"),
    (r"\bwondnds\b", "wounds"),
    (r"\belder\s+sign\s+sign\b", "elder sign"),
    (r"\bgreen\s+dice\s+dice\b", "green dice"),
    (r"\bblack\s+dice\s+dice\b", "black dice"),
]
COUNTED = ["enemy", "space", "free", "additional", "wound", "green", "black", "elder", "success", "attack", "action", "reroll", "stress", "times", "die", "dice"]
NAMES = [
    (r"\bFUELED\s+BY\s+MADNESS\b", "FUELED BY MADNESS"),
    (r"\bfig\s+vet\s+BY\s+MADNESS\b", "FUELED BY MADNESS"),
    (r"\bHEALING\s+PRAYER\b", "HEALING PRAYER"),
    (r"\bhealing\s+prayer\b", "Healing Prayer"),
]


def basic(t: Column) -> Column:
    """Cleaning with the line breaks kept, then misread words."""
    return rules.patterns(text.clean(t, keep_lines=True), [(f"(?i){a}", b) for a, b in BASIC])


def numbered(t: Column) -> Column:
    """A lone I of either case before a counted noun to 1, then names."""
    return rules.patterns(rules.patterns(t, [(rf"(?i)\bI\s+{noun}\b", f"1 {noun}") for noun in COUNTED]), NAMES)


def advanced(t: Column) -> Column:
    """Cleaning, letters for digits, domain terms, word bounds, repeats and white space, in that order."""
    return text.whitespace(text.collapse_repeats(text.word_boundaries(cards.domain_rewrite(text.letter_substitutions(text.clean(t, keep_lines=True))))))


def enhanced(t: Column) -> Column:
    return numbered(advanced(t))


def guarded(function: Callable[[str], str | None]) -> Step:
    """A Python function as a step that gives struct(text, error): a row on which it raises has the error, the others their texts."""

    def one(value: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if value is None else function(value)), None
        except Exception as error:  # a row's failure is its result
            return None, f"{type(error).__name__}: {error}"

    @F.pandas_udf("text string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["text", "error"])

    return run


@dataclass(frozen=True)
class Strategy:
    """Steps from raw text to text; ``source``, where there is one, is a Python function that runs first and may fail."""

    name: str
    steps: Sequence[Step] = ()
    source: Callable[[str], str | None] | None = None
    description: str = ""


def registry(strategies: Sequence[Strategy]) -> dict[str, Strategy]:
    """By name, in order; the first is the fallback of last resort."""
    if not strategies:
        raise ValueError("at least one strategy")
    found = {s.name: s for s in strategies}
    if len(found) < len(strategies):
        raise ValueError("names of strategies are distinct")
    return found


LEVELS = registry([Strategy("plain", [text.whitespace]), Strategy("basic", [basic]), Strategy("advanced", [advanced]), Strategy("enhanced", [enhanced])])


def chosen(wanted: Column, known: Mapping[str, Strategy], fallback: str | None = None) -> Column:
    """The wanted name if it is known, else the fallback if that is, else the first name."""
    last = fallback if fallback in known else next(iter(known))
    return F.when(wanted.isin(list(known)), wanted).otherwise(last)


def for_category(category: Column, winners: Mapping[str, str]) -> Column:
    """The configured winner of a category, null for one without."""
    return F.coalesce(*[F.when(category == c, name) for c, name in winners.items()], F.lit(None).cast("string"))


def run(t: Column, wanted: Column, known: Mapping[str, Strategy] = LEVELS, fallback: str | None = None) -> Column:
    """Struct of text (trimmed; "" for a null text or a failed row), strategy that ran, and error (null if none).

    Spark evaluates Python steps for all rows of a batch before it looks at conditions, so each is given null where another chain is chosen.
    """
    name = chosen(wanted, known, fallback)
    out, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in known.values():
        mine = F.when(name == s.name, t)
        if s.source is not None:
            read = guarded(s.source)(mine)
            mine, error = read["text"], F.coalesce(error, read["error"])
        out = F.when(name == s.name, reduce(lambda c, step: step(c), s.steps, mine)).otherwise(out)
    plain = F.regexp_replace(F.coalesce(out, F.lit("")), r"^\s+|\s+$", "")
    return F.struct(plain.alias("text"), name.alias("strategy"), error.alias("error"))
