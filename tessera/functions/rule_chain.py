"""Long tables of ordered rewrite rules, of which a text is touched by few.

Each pattern has an anchor, its longest literal stretch that every match must hold. The rules are folded
in order, and a rule's pattern is run only where its anchor stands in what the rules before it left, at its begin or end if the pattern is bound to one, so the result is that of running all of them. The plan holds the table once, as an array,
whatever its length: rules that are nested as expressions double at each condition.

Case is ignored for ASCII letters. Null stays null.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern, replacement, whether case counts); groups in replacements are \\1 to \\9.
Rule = tuple[str, str, bool]

POWER_TEXT = Path(__file__).with_name("power_text.toml")


def load(path: str | Path) -> list[Rule]:
    """Rules of a TOML file, in its order."""
    return [(pattern, replacement, case) for pattern, replacement, case in tomllib.loads(Path(path).read_text(encoding="utf-8"))["rules"]]


def anchor(pattern: str) -> str:
    """The longest stretch of characters, in lower case, that every match of the pattern holds; empty if none is certain.

    Groups, classes and what a quantifier may leave out end a stretch, and a pattern with alternatives outside groups has none.
    """
    best, run, i = "", "", 0

    def ended() -> str:
        return max(best, run, key=len)

    while i < len(pattern):
        c = pattern[i]
        literal = ""
        if c == "\\":
            literal = "" if pattern[i + 1].isalnum() else pattern[i + 1]
            i += 2
        elif c in "([":
            depth, close = 0, {"(": ")", "[": "]"}[c]
            while True:  # to the end of the group or class
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == c:
                    depth += 1
                elif pattern[i] == close:
                    depth -= 1
                i += 1
                if not depth:
                    break
        elif c == "|":
            return ""
        else:
            literal = "" if c in "^$." else c
            i += 1
        if i < len(pattern) and pattern[i] in "*?{":
            best, run, literal = ended(), "", ""
            i = pattern.index("}", i) + 1 if pattern[i] == "{" else i + 1
        elif i < len(pattern) and pattern[i] == "+":
            best, run = max(ended(), run + literal, key=len), ""
            literal = ""
            i += 1
        if literal:
            run += literal
        else:
            best, run = ended(), ""
    return ended().lower()


def edges(pattern: str) -> tuple[str, str]:
    """What a text must begin with, and what must stand before the white space at its end, for the pattern to match; empty where nothing is certain."""
    if "|" in pattern:
        return "", ""
    start = re.match(r"\^([A-Za-z0-9;,-]+)(?![*?{+])", pattern)
    left, end = pattern.removesuffix(r"\s*$"), ""
    while left != pattern and left:
        escaped = left[-2:-1] == "\\"
        if left[-1].isalnum() if escaped else not (left[-1].isalnum() or left[-1] in ",:;-"):
            break  # a class such as \s, or a sign of the pattern language
        left, end = left[: -2 if escaped else -1], left[-1] + end
    return start[1].lower() if start else "", end.lower()


def _table(rules: Sequence[Rule]) -> Column:
    rows = [(anchor(p), *edges(p), p if case else f"(?i){p}", re.sub(r"\\(\d)", r"$\1", r.replace("$", r"\$"))) for p, r, case in rules]
    return F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(row, ("anchor", "start", "end", "pattern", "by"), strict=True))) for row in rows))


def apply(text: Column, rules: Sequence[Rule]) -> Column:
    """The text after all rules, in order."""
    state = "struct<text:string,low:string,kept:string>"

    def begun(x: Column) -> Column:
        return F.struct(x.alias("text"), F.lower(x).alias("low"), F.rtrim(F.lower(x), F.lit(" \t\n\x0b\f\r")).alias("kept")).cast(state)

    def step(s: Column, rule: Column) -> Column:
        may = F.startswith(s["low"], rule["start"]) & F.endswith(s["kept"], rule["end"]) & F.contains(s["low"], rule["anchor"])
        changed = F.regexp_replace(s["text"], rule["pattern"], rule["by"])
        # bound to a name, so that a pattern is run once
        return F.when(may, F.get(F.transform(F.array(changed), lambda x: F.when(x == s["text"], s).otherwise(begun(x))), F.lit(0))).otherwise(s)

    return F.when(text.isNotNull(), F.aggregate(_table(rules), begun(text), step, lambda s: s["text"]))


def touched_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Numbers of the rules, from 0, whose anchors the text holds before any is run: what a look at a corpus says about a table."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(anchor(p))), i) for i, (p, *_) in enumerate(rules))), lambda i: i.isNotNull())
