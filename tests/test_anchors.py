"""Range joins and sections of documents against plain loops."""

import random
import re

from tessera.operators import anchors, intervals


def test_overlap_join(spark):
    r = random.Random(1)
    make = lambda: [(r.choice("xy"), i, s := r.randrange(-40, 300), s + r.randrange(-2, r.choice([4, 4, 120]))) for i in range(120)]
    left, right = make(), make()
    a = spark.createDataFrame([*left, (None, 1, 0, 9), ("x", 2, None, 9)], "k string, i int, a long, b long")
    b = spark.createDataFrame(right, "k string, j int, c long, d long")
    want = sorted((k, i, j) for k, i, s, e in left for m, j, t, u in right if k == m and max(s, t) < min(e, u))
    for width in (1, 7, 256):
        assert sorted(map(tuple, intervals.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), width).select("k", "i", "j").collect())) == want and want
    plan = intervals.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_sections(text, names):
    """(name, start, end, text) in order."""
    words = [(i, w) for i, line in enumerate(text.split("\n")) for w in line.split(" ") if w]
    found, at = [], 0
    while at < len(words):
        fit = [n for n in names if [w.lower() for _, w in words[at : at + len(n.split())]] == n.lower().split()]
        best = max(fit, key=lambda n: len(n.split()), default=None)
        if best:
            found.append((best.lower(), at))
        at += len(best.split()) if best else 1
    out = []
    for k, (name, s) in enumerate(found):
        e = found[k + 1][1] if k + 1 < len(found) else len(words)
        own = words[s:e]
        out.append((name, s, e, "".join(("" if i == 0 else "\n" if own[i - 1][0] != own[i][0] else " ") + w for i, (_, w) in enumerate(own))))
    return out


def test_sections(spark):
    r = random.Random(2)
    names = ["Arcane Mastery", "Arcane", "Stealth", "Mastery of All Things", "swift"]
    pool = ["arcane", "MASTERY", "Mastery", "of", "all", "things", "Stealth", "swiftly", "SWIFT", "level", "1:", "x\ty", "Über", "\n", "\n", " "]
    texts = ["".join(r.choice(pool) + r.choice([" ", " ", ""]) for _ in range(r.randrange(80))) for _ in range(60)] + [None, "", "\n", "stealth", "a " * 5000 + "Stealth end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(4)
    table = spark.createDataFrame([(n,) for n in [*names, " ", None, "stealth"]], "name string")
    got = sorted((x.id, x.start, x.end, x.name, x.text) for x in anchors.section_texts(df, "doc", table, first_only=False).collect())
    want = sorted((i, s, e, n, t) for i, text in enumerate(texts) if text for n, s, e, t in plain_sections(text, names))
    assert got == want and want
    first = sorted((x.id, x.name, x.start) for x in anchors.section_texts(df, "doc", table).collect())
    assert first == sorted({(i, n): (i, n, s) for i, s, _, n, _ in reversed(want)}.values())
    parts = sorted((x.id, x.name, x.occurrence, x.words) for x in anchors.lines_of_sections(df, "doc", table).collect())
    counts, plain = {}, []
    for i, _s, _, n, t in want:
        counts[i, n] = counts.get((i, n), 0) + 1
        plain += [(i, n, counts[i, n], len([w for w in line.split(" ") if w])) for line in t.split("\n")]
    assert parts == sorted(plain)
    assert anchors.sections(df, "doc", table.limit(0)).collect() == []


def plain_levels(text):
    out = {}
    for n, body in re.findall(r"(?:level|^)\s*([1234])[:\-.]?\s*(.*?)(?=(?:level|^)\s*[1234]|\Z)", text, re.I | re.S | re.M):
        body = re.sub(r"\s+", " ", body.strip(" \t\n\r\x0b\f"))
        if len(body) > 10 and not body.startswith("Appendix"):
            body = re.sub(r"\d+\s*\Z", "", body).strip(" \t\n\r\x0b\f")
            if len(body) > 10:
                out[int(n)] = body
    return out


def test_numbered_levels(spark):
    r = random.Random(3)
    pool = ["Level 1: ", "LEVEL 2 ", "\n3. ", "\n4-", "level", "Gain one green dice while attacking ", "short", " 12", "\n", "Appendix B and more text ", "reroll a dice ", "5: "]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(14))) for _ in range(300)] + ["", None, "Level 1: Attack with one more dice.\n\nLevel 2: Attack with two more dice. 17"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {x.i: x.levels for x in rows.select("i", anchors.numbered_levels(rows.text).alias("levels")).collect()}
    assert got == {i: None if t is None else plain_levels(t) for i, t in enumerate(texts)}
    assert got[302] == {1: "Attack with one more dice.", 2: "Attack with two more dice."}


def test_words_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "\n one two\n\ntwo  three\n")], "doc_id long, text string")
    assert sorted(map(tuple, anchors.line_ranges(docs, "doc_id").collect())) == [(1, 1, 0, 2), (1, 3, 2, 4)]
    names = spark.createDataFrame([("Two three",), ("two",)], "name string")
    assert sorted(map(tuple, anchors.anchors(docs, "doc_id", names).collect())) == [(1, 1, 1, "two"), (1, 2, 2, "two three")]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (anchors.line_ranges(docs, "doc_id"), anchors.anchors(docs, "doc_id", names))]
    # no row for every word: lines come out whole, and only words that begin a name leave the text
    assert not any("posexplode" in p for p in plans)
    assert anchors.anchors(docs, "doc_id", names.limit(0)).count() == 0
