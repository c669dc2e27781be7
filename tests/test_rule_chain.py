"""Rule tables against the plain ordered fold."""

import random
import re

import pytest

from tessera.functions import rule_chain

RULES = rule_chain.load(rule_chain.POWER_TEXT)
PIECES = [
    "within 7 space of a .", "space of a ,", "guidemce", "J EY eemaerewrerenerean Gili S: x", "hove", "gain and have", "GAIN green dice", "with 1 space of a gate", "Rest action", " --", " - ", "e C", "e C.", "wound die", "Wound NOT", "fo life", "ail your",
    "count 3 and as", "aso", "os a", "I of your wounds", "13 total", "Bb", ". ", "ee a", "x )", " q", ").", ",", "; ", "d, ", "FON Nee a ", "you:b", " ee", "1 additional ", "ain while your sanity", "gain while your sanity", "gain eer", "gain eee", "ona", "ona OR",
    "on a or", "on r OR", "on r", "buck", "vmnmaenmeenn ad ", "nce fe ", "-f Nv ES ", "oo. (Y", " . - : ", "atfackers", "for each you count", "heal oll", "drow", "af the", "gain.", "Yo. 6S", "ENS bas ", " - 1", "some other words", "$1 \\1", "\n",
]


def plain(text):
    for pattern, replacement, case in RULES:
        text = text and re.sub(pattern, replacement, text, flags=0 if case else re.I)
    return text


@pytest.mark.parametrize(
    "pattern,want",
    [(r"\bwound\s+(die|not)\b", "wound"), (r"ab?cd", "cd"), (r"a+b", "a"), (r"(?:x|y)z\.", "z."), ("ab|cd", ""), (r"[abc]d{2}ef", "ef"), (r"\s+oo\.\s*\(Y\s*$", "oo."), (r"\d+", ""), ("xY+z", "xy")],
)
def test_anchor(pattern, want):
    assert rule_chain.anchor(pattern) == want


def test_every_match_holds_its_anchor():
    for pattern, _, case in RULES:
        for piece in PIECES:
            for m in re.finditer(pattern, piece, 0 if case else re.I):
                assert rule_chain.anchor(pattern) in m[0].lower()


def test_chain_equals_the_ordered_fold(spark):
    r = random.Random(6)
    texts = [r.choice(["", " "]).join(r.choice(PIECES) for _ in range(r.randrange(7))) for _ in range(1500)] + [*PIECES, None, "", "ños a", "élan buck", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {x.i: x.t for x in df.select("i", rule_chain.apply(df.text, RULES).alias("t")).collect()}
    assert all(got[i] == plain(t) for i, t in enumerate(texts)), [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)][:5]
    assert sum(got[i] != t for i, t in enumerate(texts)) > 1000
    plan = df.select(rule_chain.apply(df.text, RULES * 20).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: x.t for x in docs.select("doc_id", rule_chain.apply(docs.text, RULES).alias("t")).collect()}
    want = {x.doc_id: plain(x.text) for x in docs.collect()}
    assert got == want
