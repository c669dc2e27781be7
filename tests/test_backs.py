"""The line automaton of card backs against a plain loop over lines."""

import random
import re

from tessera.operators import backs

NAMES = ["Arcane Mastery", "Brawling", "Marksman", "Stealth"]


def words(x):
    return x.split()


def plain_certain(lines, i):
    line, low = lines[i], lines[i].lower()
    if "fueled" in low and "madness" in low:
        run = []
        for w in words(line):
            if w[0].isupper() or w.lower() in ("by", "the"):
                run.append(w)
            elif run:
                break
        if run:
            return " ".join(run)
    if ("healing" in low and "prayer" in low) or (("at the end" in low or "atthe end" in low) and "turn" in low and ("heal" in low or "wound" in low)):
        for prev in reversed(lines[max(0, i - 5) : i]):
            at = [[k for k, w in enumerate(words(prev)) if x in w.lower()] for x in ("healing", "prayer")]
            if all(at):
                a, b = sorted(x[-1] for x in at)
                return " ".join(words(prev)[a : b + 1])
        return "Healing Prayer"
    return None


def acts(low):
    return any(a in low for a in backs.ACTIONS) or bool(re.match(r"(?:level\s*)?[1234]", low))


def plain_suggested(lines, i):
    low = lines[i].lower()
    some = lambda words, part: any(w in x.lower() for x in part for w in words)
    if (some(backs.GAIN, [low]) and some(backs.SANITY, lines[i : i + 4])) or (some(backs.SANITY, [low]) and some(backs.GAIN, lines[max(0, i - 3) : i])):
        return "Fueled by Madness"
    if not acts(low) or not any(acts(x.lower()) or x.lower().startswith("instead") for x in lines[i + 1 : i + 4]):
        return None
    for prev in reversed(lines[max(0, i - 5) : i]):
        quote = prev[0] in "\"'" or prev[-1] in "\"'" or some(backs.MOTTO_MARKS, [prev])
        if not quote and not some(backs.NO_NAMES, [prev]) and len(words(prev)) <= 4 and prev[0].isupper() and prev[-1] not in ".,:" and not any(n.upper() in prev.upper() for n in NAMES):
            return prev
    first = low.split()[:5]
    for keys, name in backs.ABOUT:
        if any(k in first for k in keys):
            return name
    run = []
    for w in words(lines[i])[:3]:
        if w[0].isupper() and len(w) > 2:
            run.append(w)
        elif run:
            break
    return " ".join(run) or "Special Power"


def plain_common(line):
    for n in NAMES:
        if re.search(rf"\b{n.upper()}\b", line.upper()) or (n.upper() in line.upper() and len(line) <= len(n) + 10):
            return n
    return None


def plain_powers(text):
    if text is None:
        return None
    lines = [x for x in (re.sub(r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$", "", s) for s in text.split("\n")) if x]
    done, found, seen, name, special, levels, open_text = {}, None, False, None, False, [], ""

    def put_away():
        nonlocal found
        if name and special:
            found = (name, levels)
        elif name:
            done.setdefault(name, levels)

    def closed():
        return [*levels, open_text] if len(words(open_text)) > 2 and len(levels) < 4 else levels

    for i, line in enumerate(lines):
        low = line.lower()
        if any(k in line.upper() for k in ("YOUR TURN", "TAKE", "DRAW MYTHOS", "INVESTIGATE", "FIGHT", "RESOLVE")):
            continue
        s, c = plain_certain(lines, i) or (None if seen else plain_suggested(lines, i)), plain_common(line)
        seen = seen or c is not None
        if s or c:
            put_away()
            name, special, levels, open_text = (s, True, [], line) if s else (None if c in done else c, False, [], "")
        elif name is None:
            continue
        elif m := re.match(r"(?i)(?:level\s*)?\d+[:\-]?\s*", line):
            levels, open_text = closed(), line[m.end() :].strip(" ")
        elif m := re.match(r"(?i)instead[,\s]*", line):
            open_text = line[m.end() :].strip(" ")
        elif special and levels and (m := re.match(r"[^a-z]*instead[,\s]+", low)):
            open_text = line[m.end() :].strip(" ")
        elif any(low.startswith(p) for p in backs.DESCRIPTIONS) or (re.match("[A-Z]", line) and len(words(line)) > 2) or (len(words(line)) <= 8 and not line[0].isupper() and open_text):
            open_text = f"{open_text} {line}" if open_text else line
        elif open_text and len(levels) < 4 and not (i + 1 < len(lines) and any(n.upper() in lines[i + 1].upper() for n in NAMES)):
            levels, open_text = closed(), ""
    still = name is not None
    levels = closed()
    put_away()
    if still:
        for n in NAMES:
            if any(len(x) <= 60 and not any(k in x.upper() for k in backs.DESCRIBING) and re.search(rf"\b{n.upper()}\b", x.upper()) and len(x) <= len(n) + 10 for x in lines):
                done.setdefault(n, [])
    return found, list(done.items())


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4)
    out = {}
    for r in df.select("i", backs.powers(df.text, NAMES).alias("b")).collect():
        out[r.i] = r.b and (r.b.special and (r.b.special.name, r.b.special["levels"]), [(p.name, p["levels"]) for p in r.b.powers])
    return out


def test_a_card(spark):
    text = """Fueled by Madness
Level 1: Gain one green dice while sane
Level 2: Gain two green dice while sane
ARCANE MASTERY
1: You may reroll one dice
when attacking a cultist
2: You may reroll two dice
YOUR TURN take three actions
Instead, you may reroll all dice
STEALTH
Attackers roll one fewer dice
x
BRAWLING"""
    got = parsed(spark, [text, None, "", " \n "])
    assert got[0] == plain_powers(text)
    special, powers = got[0]
    assert special == ("Fueled by Madness", [])  # before a name of the vocabulary, lines of levels suggest a power anew
    assert powers == [("Arcane Mastery", ["You may reroll one dice when attacking a cultist"]), ("Stealth", []), ("Brawling", [])]  # a name ends an open text without keeping it
    assert (got[1], got[2], got[3]) == (None, (None, []), (None, []))


def test_automaton_equals_the_loop(spark):
    r = random.Random(8)
    pool = [
        "Fueled by Madness", "the Fueled by the Madness of", "Healing Prayer", "HEALING of a Prayer now", "At the end of your turn heal one wound", "Gain 1 sanity", "goin", "santiy is lost", "Level 1: Gain one green dice", "level 2",
        "3- You may move again now", "4:", "12 swords", "Instead, deal two wounds", "instead", "... instead, reroll a dice", "ARCANE MASTERY", "Arcane  Mastery", "xBRAWLING", "Brawling and Stealth", "Marksman gains a free action when attacking", "stealthy steps",
        "STEALTH", "YOUR TURN", "take a card", "The Old House", "Silent Step.", "\"Trust me\"", "When you run, move one space", "Attackers are slow here", "and so on it goes", "Über dem Haus steht", "x", "sneak past them", "Deal damage", "additional text that is longer than eight words in all", "Reduce wounds", " \t", "",
    ]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(16))) for _ in range(700)]
    got = parsed(spark, texts)
    for i, text in enumerate(texts):
        want = plain_powers(text)
        assert got[i] == (want[0] and (want[0][0], want[0][1]), want[1]), text


def test_fold_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "STEALTH\n1: one two three")], "i long, text string")
    found = backs.back_powers(df, "i", NAMES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, False, 0, "Stealth", ["one two three"])]


def test_documents_as_backs(spark, sf_dir, monkeypatch):
    import hashlib

    from tessera.plans import lookup_queries

    monkeypatch.setattr("tests.test_backs.NAMES", lookup_queries.BACK_NAMES)
    want = []
    for doc, text in lookup_queries.numbered_text(spark, sf_dir).select("doc_id", "text").collect():
        special, found = plain_powers(text) or (None, [])
        rows = [(False, *p) for p in found] + ([(True, *special)] if special else [])
        want += [(doc, s, i, n, len(x), hashlib.md5("|".join(x).encode()).hexdigest()) for i, (s, n, x) in enumerate(rows)]
    got = sorted(map(tuple, lookup_queries.back_text_powers(spark, sf_dir).collect()))
    assert got == sorted(want) and {x[1] for x in want} == {True, False}


def test_a_line_is_searched_once(spark, sf_dir):
    from tessera.plans import lookup_queries

    plan = lookup_queries.back_text_powers(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # a word of actions: what a line says by itself is noted once, and lines around it read the note
    assert plan.count("during a run") == 1
