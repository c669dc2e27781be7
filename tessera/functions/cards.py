"""Names, mottoes and stories out of noisy multi-line texts, and checks of one field against another."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rules import KEY_PHRASES
from tessera.functions.similarity import _indel

#: Words that mottoes, their beginnings and ends, and stories hold.
MOTTO_WORDS = ["first", "never", "always", "shoot", "ask", "trust", "certain", "life"]
MOTTO_STARTS = ["shoot", "never", "always", "first", "trust", "certain"]
MOTTO_ENDS = ["ask", "never", "always", "trust", "certain", "life", "things"]
STORY_COMMON = ["the", "and", "of", "to", "a", "in", "is", "it", "that", "for", "his", "but", "most"]
STORY_WORDS = ["signature", "warning", "thoughts", "demeanor", "investigators", "reserve", "fellow", "glare", "battled", "cults", "decades", "maintaining"]
#: Capitals that speak of rules, in a paragraph and in a line.
RULE_WORDS = ["YOUR", "TURN", "TAKE", "ACTIONS", "DRAW", "MYTHOS", "INVESTIGATE", "FIGHT"]
RULE_LINES = ["YOUR TURN", "TAKE", "DRAW MYTHOS", "INVESTIGATE", "FIGHT", "RESOLVE"]
#: Terms and the spellings that stand for them.
DOMAIN_TERMS = {
    "marksman": ["marksman", "marksmen", "markman"],
    "toughness": ["toughness", "toughnes", "toughnss"],
    "stealth": ["stealth", "steath", "stelth"],
    "brawling": ["brawling", "brawlling"],
    "swiftness": ["swiftness", "swiftnes", "swiftnss"],
    "sanity": ["sanity", "santiy", "sanitiy", "santity"],
    "stress": ["stress", "stres", "strees"],
    "wound": ["wound", "woundnds", "wond", "wonds"],
    "investigator": ["investigator", "investigater"],
    "gain": ["gain", "goin"],
    "instead": ["instead", "insted"],
    "attack": ["attack", "attak", "atack"],
    "reroll": ["reroll", "re-roll"],
}


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def _capitals(line: Column) -> Column:
    return line.rlike("[A-Z]") & ~line.rlike("[a-z]")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), F.trim), lambda s: s != "")


def rules_line(line: Column) -> Column:
    return _any(F.upper(line), RULE_LINES)


def name_line(text: Column, least: int = 3) -> Column:
    """The longest line that is all capitals once marks and digits in front are off; the first of equally long ones, or null."""
    cleaned = F.transform(_lines(text), lambda s: F.trim(F.regexp_replace(s, r"^[\d\s\-_|~pP]+", "")))
    named = F.transform(F.filter(cleaned, lambda s: _capitals(s) & (F.length(s) >= least)), lambda s, i: F.struct(-F.length(s), i, s.alias("s")))
    return F.array_min(named)["s"]


def motto(text: Column, name: Column | None = None, place: Column | None = None) -> Column:
    """A quoted motto, else two short lines that make one, else one short line; null without any. Run it on raw text: cleaning drops quotes."""
    quoted = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"')), F.trim), lambda q: F.length(q).between(6, 99) & _any(F.lower(q), MOTTO_WORDS)), F.lit(0))
    lines = _lines(text)
    short = lambda s, n: (F.size(F.split(s, r"\s+")) <= n) & ~_capitals(s)
    pairs = F.transform(F.slice(lines, 1, 15), lambda s, i: F.when((i > 0) & _any(F.lower(s), MOTTO_STARTS) & short(s, 5) & _any(F.lower(F.get(lines, i + 1)), MOTTO_ENDS) & short(F.get(lines, i + 1), 5), F.concat(s, F.lit(" "), F.get(lines, i + 1))))
    pair = F.get(F.filter(pairs, lambda s: s.isNotNull() & F.length(s).between(11, 99)), F.lit(0))
    other = lambda s: ~F.coalesce(*[F.contains(F.lower(s), F.lower(c)) for c in (name, place) if c is not None], F.lit(False))
    single = F.get(F.filter(F.slice(lines, 1, 20), lambda s: other(s) & (F.size(F.split(s, r"\s+")) >= 2) & short(s, 8) & _any(F.lower(s), MOTTO_WORDS) & (F.length(s) < 100)), F.lit(0))
    return F.coalesce(quoted, pair, single)


def paragraph_score(paragraph: Column) -> Column:
    """How much a paragraph looks like a story; -1000 for short ones and for capitals."""
    p = F.trim(paragraph)
    words = F.split(F.lower(p), r"\s+")
    marks = F.length(p) - F.length(F.regexp_replace(p, "[@#$%^&*|~`]", ""))
    common = F.size(F.filter(words, lambda w: w.isin(STORY_COMMON)))
    story = sum((F.contains(F.lower(p), F.lit(w)).cast("int") for w in STORY_WORDS), F.lit(0))
    score = F.length(p) + F.size(words) * 5 - marks * 5 + common * 3 + story * 10 - F.when(_any(F.upper(p), RULE_WORDS), 100).otherwise(0)
    return F.when((F.length(p) <= 80) | _capitals(p), -1000).otherwise(score)


def story(text: Column) -> Column:
    """The best-scored paragraph with a positive score, the first of equals; paragraphs end at empty lines."""
    scored = F.transform(F.split(text, r"\n\s*\n"), lambda p, i: F.struct(-paragraph_score(p), i, F.trim(p).alias("p")))
    best = F.array_min(scored)
    return F.when(best["col1"] < 0, best["p"])


def unique_sentences(text: Column, overlap: float = 0.6) -> Column:
    """Sentences joined again without those that share ``overlap`` of their words with an earlier one that stays."""
    bag = lambda s: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(s), r"[^\w\s]", ""), r"\s+"), lambda w: w != ""))
    every = F.transform(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""), lambda s: F.struct(F.trim(s).alias("s"), bag(s).alias("w")))
    same = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) >= overlap)
    kept = F.aggregate(every, F.filter(every, lambda x: F.lit(False)), lambda done, x: F.when(F.exists(done, lambda d: same(d["w"], x["w"])), done).otherwise(F.array_append(done, x)))
    return F.array_join(F.transform(kept, lambda x: x["s"]), " ")


def domain_rewrite(text: Column, terms: Mapping[str, Sequence[str]] = DOMAIN_TERMS, least: float = 75.0) -> Column:
    """Words that are near to a spelling of a term become the term: of the first term, in order, with a spelling that near.

    Each distinct word is compared once per batch.
    """
    word = re.compile(r"\b\w+\b")

    def term(w: str) -> str | None:
        for name, spellings in terms.items():
            score, best = max(((_indel(w, s), s) for s in spellings), key=lambda x: x[0])
            if score >= least and best != w:
                return name
        return None

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}

        def one(m: re.Match) -> str:
            w = m[0].lower()
            if w not in known:
                known[w] = term(w)
            return known[w] or m[0]

        return texts.map(lambda t: word.sub(one, t), na_action="ignore")

    return rewrite(text)


def consistency_issues(description: Column, effect: Column, green: Column, black: Column) -> Column:
    """Where a description says something that its figures or its effect text do not."""
    d, e = F.lower(description), F.lower(effect)
    free = ~_any(d, ["when", "while"])
    speaks = lambda text, *topics: _any(text, [p for t in topics for p in KEY_PHRASES[t]])
    return F.array_compact(
        F.array(
            F.when(F.contains(d, F.lit("green dice")) & (green == 0) & free, "green dice"),
            F.when(F.contains(d, F.lit("black dice")) & (black == 0) & free, "black dice"),
            F.when(speaks(d, "elder_sign") & speaks(d, "success") & F.contains(d, F.lit("count")) & ~speaks(e, "elder_sign", "success"), "conversion"),
            F.when(F.contains(d, F.lit("free")) & speaks(d, "attack", "action") & ~speaks(e, "attack", "action"), "free action"),
        )
    )
