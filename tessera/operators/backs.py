"""Powers and their levels out of the text of a card's back: a line automaton, folded inside the JVM by ``aggregate``.

Every line is first described by what it and a few lines around it say: a special power's name, a name of the vocabulary, a level's mark, the begin or the course of a
description. The fold then reads these in order. Its state is the power that is open, the levels it has and the text of the level that is open:

1. Lines of game rules say nothing.
2. A special power's name, or one that its surroundings suggest while no name of the vocabulary has been seen, puts the open power away and opens a special one, whose text begins with the line.
3. A name of the vocabulary puts the open power away and opens that one; one that is there already opens none. What is put away so keeps its levels, but not the text still open.
4. A level's mark closes the text before it as a level; "instead" drops it. Both begin a text with the rest of the line.
5. A description's line goes on with the text; any other line closes it as a level, unless a name follows.

A text is a level if it has more than two words and the power has fewer than four. Of special powers the last counts. If a power is open at the end, names of the vocabulary that stand on
short lines but opened nothing are added without levels. Null texts give null, empty ones no powers. Names are read as they are written: for misread ones see
``vocabulary.fuzzy``. Texts should be cleaned first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cards import rules_line
from tessera.functions.scoring import let

#: What actions say, and what begins a description.
ACTIONS = ["when you run", "when attacking", "when you attack", "when attacked", "during a run", "you may", "deal", "wound", "heal", "stress", "move", "additional", "sneak", "free", "reroll"]
DESCRIPTIONS = ["you may", "instead", "gain", "when", "reduce", "attacking", "target"]
#: Words of lines that are no names, and of lines that describe.
NO_NAMES = ["your turn", "take", "draw", "investigate", "fight", "resolve", "mythos", "card", "actions", "safe space"]
MOTTO_MARKS = ["certain", "life", "things"]
DESCRIBING = ["LEVEL", "DESCRIPTION", "GAIN", "ADD", "WHEN", "YOU", "MAY", "INSTEAD", "DICE", "SUCCESS"]
#: Spellings of two words that tell one special power, and its name and another's.
GAIN, SANITY = ["gain", "goin", "go in"], ["sanity", "santiy"]
FUELED, PRAYER = "Fueled by Madness", "Healing Prayer"
#: Names after what an action is about.
ABOUT = [(["run", "move"], "Movement Power"), (["attack", "wound", "deal"], "Combat Power"), (["heal", "stress"], "Healing Power"), (["sneak"], "Stealth Power"), (["reroll"], "Reroll Power")]
OTHERWISE = "Special Power"
#: Levels of a power, words that a level has more of, characters by which a line may be longer than a name, and of the longest line that is swept.
LEVELS, WORDS, LONGER, SWEPT = 4, 2, 10, 60

POWER = "struct<name:string,levels:array<string>>"
_STATE = f"struct<seen:boolean,name:string,special:boolean,levels:array<string>,text:string,done:array<{POWER}>,found:{POWER}>"
_LEVEL = r"^(?:level\s*)?\d+[:\-]?\s*"
_COUNTED = r"^(?:level\s*)?[1234][:\-]?\s*"


def _holds(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(reduce(or_, (F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _bounded(upper: Column, name: str) -> Column:
    return upper.rlike(rf"(?U)\b{re.escape(name.upper())}\b")


def vocabulary_name(line: Column, names: Sequence[str]) -> Column:
    """The first of ``names`` that stands in the line between word bounds, or anywhere in a line of about its length."""
    return let(F.upper(line), lambda upper: _vocabulary_name(line, upper, names))


def _vocabulary_name(line: Column, upper: Column, names: Sequence[str]) -> Column:
    # few lines hold a name at all, and only those are searched for its bounds
    return F.coalesce(*(F.when(F.contains(upper, F.lit(n.upper())) & ((F.length(line) <= len(n) + LONGER) | _bounded(upper, n)), n) for n in names))


def _capitals(words: Column, allowed: str) -> Column:
    """The first run of words that begin with a capital, or match ``allowed``; null without one."""
    fit = F.transform(words, lambda w: w.rlike(rf"^\p{{Lu}}|{allowed}"))
    start = F.array_position(fit, True)
    gap = F.array_position(F.slice(fit, start, F.size(fit)), False)
    run = F.slice(words, start, F.when(gap > 0, gap - 1).otherwise(F.size(words)))
    return F.when(start > 0, F.array_join(run, " "))


def _seen(line: Column) -> Column:
    """A line with what is looked at most: in either case, and its words."""
    return F.struct(line.alias("line"), F.lower(line).alias("low"), F.upper(line).alias("upper"), _words(line).alias("words"))


def _noted(x: Column, upper_names: Sequence[str]) -> Column:
    """What a line (see ``_seen``) says by itself, for it and for the lines around it."""
    line, low, words = x["line"], x["low"], x["words"]
    at = lambda w: F.array_max(F.transform(words, lambda y, k: F.when(_holds(F.lower(y), [w]), k)))
    healing_prayer = let(F.array(at("healing"), at("prayer")), lambda ends: F.array_join(F.slice(words, F.array_min(ends) + 1, F.array_max(ends) - F.array_min(ends) + 1), " "))
    names_one = _holds(x["upper"], upper_names)
    quoted = line.rlike("^[\"']|[\"']$") | _holds(low, MOTTO_MARKS)
    named = F.size(words).between(1, 4) & line.rlike(r"^\p{Lu}") & ~names_one & ~line.rlike("[.,:]$")
    return F.struct(
        line.alias("line"),
        low.alias("low"),
        x["upper"].alias("upper"),
        words.alias("words"),
        names_one.alias("names_one"),
        _holds(low, GAIN).alias("gains"),
        _holds(low, SANITY).alias("sane"),
        (_holds(low, ACTIONS) | F.coalesce(low.rlike(_COUNTED), F.lit(False))).alias("acts"),
        F.startswith(low, F.lit("instead")).alias("instead"),
        F.when(_holds(low, ["healing"]) & _holds(low, ["prayer"]), healing_prayer).alias("prayer"),
        F.when(named & ~quoted & ~_holds(low, NO_NAMES), line).alias("title"),
    )


def _around(noted: Column, i: Column, steps: Sequence[int], *flags: str) -> Column:
    """Whether one of the lines at some steps from the i-th has one of the flags."""
    return reduce(or_, (F.coalesce(F.get(noted, i + k)[f], F.lit(False)) for k in steps for f in flags))


def _certain_name(noted: Column, x: Column, i: Column) -> Column:
    """The name of a special power whose own words the line has."""
    low = x["low"]
    fueled = F.when(_holds(low, ["fueled"]) & _holds(low, ["madness"]), _capitals(x["words"], "(?i)^(by|the)$"))
    ends_turn = _holds(low, ["at the end", "atthe end"]) & _holds(low, ["turn"]) & _holds(low, ["heal", "wound"])
    before = [F.get(noted, i - k)["prayer"] for k in range(1, 6)]
    return F.coalesce(fueled, F.when(x["prayer"].isNotNull() | ends_turn, F.coalesce(*before, F.lit(PRAYER))))


def _suggested_name(noted: Column, x: Column, i: Column) -> Column:
    """The name of a special power that the lines around suggest."""
    madness = (x["gains"] & (x["sane"] | _around(noted, i, range(1, 4), "sane"))) | (x["sane"] & _around(noted, i, range(-3, 0), "gains"))
    start = F.slice(F.split(x["low"], r"\s+"), 1, 5)
    about = F.coalesce(*(F.when(F.arrays_overlap(start, F.array(*map(F.lit, words))), name) for words, name in ABOUT))
    # a capital and more than two characters, among the first three words
    own = _capitals(F.transform(F.slice(x["words"], 1, 3), lambda w: F.when(F.length(w) > 2, w).otherwise("-")), "^$")
    given = F.coalesce(*(F.get(noted, i - k)["title"] for k in range(1, 6)), about, own, F.lit(OTHERWISE))
    return F.when(madness, FUELED).when(x["acts"] & _around(noted, i, range(1, 4), "acts", "instead"), given)


def _described(noted: Column, names: Sequence[str]) -> Column:
    """What each line says to the automaton, out of what it and the lines around it say by themselves."""

    def one(x: Column, i: Column) -> Column:
        line, low, n = x["line"], x["low"], F.size(x["words"])
        upper_names = [name.upper() for name in names]
        begins = F.coalesce(*(F.when(F.startswith(low, F.lit(p)), True) for p in DESCRIPTIONS), F.lit(False)) | (line.rlike("^[A-Z]") & (n > WORDS) & ~x["upper"].isin(upper_names))
        return F.struct(
            line.alias("line"),
            rules_line(line).alias("rule"),
            _certain_name(noted, x, i).alias("certain"),
            _suggested_name(noted, x, i).alias("suggested"),
            F.when(x["names_one"], _vocabulary_name(line, x["upper"], names)).alias("common"),
            F.when(low.rlike(_LEVEL), F.trim(F.regexp_replace(line, f"(?i){_LEVEL}", ""))).alias("mark"),
            F.when(x["instead"], F.trim(F.regexp_replace(line, r"(?i)^instead[,\s]*", ""))).alias("instead"),
            F.when(F.contains(low, F.lit("instead")) & low.rlike(r"^[^a-z]*instead[,\s]+"), F.trim(F.regexp_replace(line, r"(?i)^[^a-z]*instead[,\s]+", ""))).alias("later"),
            begins.alias("begins"),
            ((n <= 8) & ~line.rlike(r"^\p{Lu}") & ~x["names_one"]).alias("continues"),
            F.coalesce(F.get(noted, i + 1)["names_one"], F.lit(False)).alias("before_name"),
        )

    return F.transform(noted, one)


def _closed(state: Column) -> Column:
    """Levels once the open text is closed."""
    fit = (F.size(_words(state["text"])) > WORDS) & (F.size(state["levels"]) < LEVELS)
    return F.when(fit, F.concat(state["levels"], F.array(state["text"]))).otherwise(state["levels"])


def _saved(state: Column, levels: Column | None = None) -> tuple[Column, Column]:
    """Powers of the vocabulary, and the special one, once the open power is put away."""
    power = F.struct(state["name"].alias("name"), (state["levels"] if levels is None else levels).alias("levels")).cast(POWER)
    new = state["name"].isNotNull() & ~state["special"] & ~F.exists(state["done"], lambda p: p["name"] == state["name"])
    return F.when(new, F.concat(state["done"], F.array(power))).otherwise(state["done"]), F.when(state["name"].isNotNull() & state["special"], power).otherwise(state["found"])


def _step(state: Column, line: Column) -> Column:
    def to(**changed: Column) -> Column:
        fields = ("seen", "name", "special", "levels", "text", "done", "found")
        return F.struct(*(changed.get(f, state[f]).alias(f) for f in fields)).cast(_STATE)

    done, found = _saved(state)
    nothing = F.array().cast("array<string>")
    special = F.coalesce(line["certain"], F.when(~state["seen"], line["suggested"]))
    known = F.exists(done, lambda p: p["name"] == line["common"])
    goes_on = line["begins"] | (line["continues"] & (state["text"] != ""))
    longer = F.when(state["text"] == "", line["line"]).otherwise(F.concat(state["text"], F.lit(" "), line["line"]))
    return (
        F.when(line["rule"], state.cast(_STATE))
        .when(special.isNotNull(), to(seen=state["seen"] | line["common"].isNotNull(), name=special, special=F.lit(True), levels=nothing, text=line["line"], done=done, found=found))
        .when(line["common"].isNotNull(), to(seen=F.lit(True), name=F.when(~known, line["common"]), special=F.lit(False), levels=nothing, text=F.lit(""), done=done, found=found))
        .when(state["name"].isNull(), state.cast(_STATE))
        .when(line["mark"].isNotNull(), to(levels=_closed(state), text=line["mark"]))
        .when(line["instead"].isNotNull(), to(text=line["instead"]))
        .when(line["later"].isNotNull() & state["special"] & (F.size(state["levels"]) > 0), to(text=line["later"]))
        .when(goes_on, to(text=longer))
        .when((state["text"] != "") & (F.size(state["levels"]) < LEVELS) & ~line["before_name"], to(levels=_closed(state), text=F.lit("")))
        .otherwise(state.cast(_STATE))
    )


def powers(text: Column, names: Sequence[str]) -> Column:
    """struct<special, powers> of a text: the special power or null, and those of the vocabulary ``names`` in order, each with its levels' texts."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    upper_names = [n.upper() for n in names]
    noted = F.transform(F.transform(lines, _seen), lambda x: _noted(x, upper_names))
    # bound to a name, so that a line is looked at once, however many lines ask what stands around them
    return F.when(text.isNotNull(), let(noted, lambda own: _parsed(own, names)))


def _parsed(noted: Column, names: Sequence[str]) -> Column:
    start = F.struct(F.lit(False), F.lit(None), F.lit(False), F.array(), F.lit(""), F.array(), F.lit(None)).cast(_STATE)

    def finish(state: Column) -> Column:
        done, found = _saved(state, _closed(state))
        short = F.filter(noted, lambda x: x["names_one"] & (F.length(x["line"]) <= SWEPT) & ~_holds(x["upper"], DESCRIBING))

        def missed(n: str) -> Column:
            stands = F.exists(short, lambda x: (F.length(x["line"]) <= len(n) + LONGER) & _bounded(x["upper"], n)) & ~F.exists(done, lambda p: p["name"] == n)
            return F.when(stands, F.array(F.struct(F.lit(n), F.array()).cast(POWER))).otherwise(F.array().cast(f"array<{POWER}>"))

        return F.struct(found.alias("special"), F.when(state["name"].isNotNull(), F.concat(done, *map(missed, names))).otherwise(done).alias("powers"))

    return F.aggregate(_described(noted, names), start, _step, finish)


def back_powers(rows: DataFrame, identifier: str, names: Sequence[str], text: str = "text") -> DataFrame:
    """(id, special, pos, name, levels): every power of every text, pos from 0, the special one last."""
    parsed = rows.select(F.col(identifier).alias("id"), powers(F.col(text), names).alias("_back"))
    each = F.concat(F.transform("_back.powers", lambda p: F.struct(F.lit(False).alias("special"), p.alias("power"))), F.when(F.col("_back.special").isNull(), F.array().cast(f"array<struct<special:boolean,power:{POWER}>>")).otherwise(F.array(F.struct(F.lit(True).alias("special"), F.col("_back.special").alias("power")))))
    return parsed.select("id", F.posexplode(each).alias("pos", "_at")).select("id", "_at.special", "pos", "_at.power.name", "_at.power.levels")
