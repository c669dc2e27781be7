"""Gates, accepted names, paragraphs, strategies, sort states, work lists and fields of several shapes against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import gates, strategies, variants
from tessera.operators import acceptance, paragraphs, ranking
from tessera.sources import worklist


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    a, b = sorted((a, b), key=len)
    return max(indel(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b))) if a else (0.0 if b else 100.0)


def plain_verdict(line, name, previous):
    """The gates one after another, as a loop reads them."""
    line, previous = line.strip(), previous.strip() if previous else previous
    same = lambda x: x.upper() == name.upper()
    if len(line) > 20 and name != "Arcane Mastery":
        return "long"
    bare = line.rstrip(gates.MARKS).strip()
    near = partial(bare.upper(), name.upper())
    fuzzy = max(indel(bare.upper(), name.upper()), near) >= 60 and not same(bare)
    if not same(line) and (len(line) == 2 or len(line) < 4 and not fuzzy):
        return "short"
    was = line
    if len(line) < len(name) * 0.5:
        if fuzzy or near >= 75:
            if partial(line.upper(), name.upper()) < 75 and len(line) < 3:
                return "short"
        elif len(line) >= 3 and bare and same(bare):
            line = bare
        elif len(line) < 3 or indel(line.upper(), name.upper()) < 60:
            return "short"
    up, words = line.upper(), name.upper().split()
    if not fuzzy:
        if len(line) > len(name) + 10:
            bad = True
        elif len(words) > 1 and words[1][:2] in up:
            bad = False
        elif len(name) > len(line) + 3:
            bad = True
        elif len(words) > 1:
            bad = bool(up.split()) and words[0][:2] not in up
        else:
            bad = len(line) < len(name) - 1 and words[0][:2] not in up and indel(up, name.upper()) < 85
        if bad:
            bare = line.lstrip(gates.MARKS).strip()
            if not bare or not same(bare):
                return "part"
            line = bare
        ratio, longer = indel(line.upper(), name.upper()), len(line) - len(name)
        if line == was and not same(line) and not (longer <= 5 and (ratio >= 75 or ratio >= 60 and abs(longer) <= 5)):
            return "unlike"
    if not same(line) and (any(w in line.upper() for w in gates.DESCRIPTION_WORDS) or previous and len(previous) > 50 and previous.upper().endswith(tuple(gates.DESCRIPTION_ENDS))):
        return "description"
    return "accepted"


POWERS = ["Arcane Mastery", "Brawling", "Marksman", "Stealth", "Swiftness", "Toughness", "Aid", "Adept of Ash"]


def test_gates_against_a_loop(spark):
    r = random.Random(7)

    def noisy(name):
        s = list(name.upper() if r.random() < 0.5 else name)
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            i = r.randrange(len(s) + 1)
            s[i : i + r.choice([0, 1, 1, 3])] = r.choice(["", "x", "|", ".", "AD ", "-- "])
        s = "".join(s)[r.choice([0, 0, 0, 2, 5]) :]
        return r.choice(["", "", ": ", "..."]) + s[: r.choice([2, 3, 5, 9, 40])] + r.choice(["", "", " -", ".,", " gain 1", " and then very much more"])

    ends = [None, "", "x" * 60, "y" * 60 + " one wound", "one wound"]
    rows = [(i, noisy(n), m, r.choice(ends)) for i in range(1500) for n in [r.choice(POWERS)] for m in [n if r.random() < 0.8 else r.choice(POWERS)]]
    df = spark.createDataFrame([*rows, (-1, None, "Aid", None), (-2, "Aid", None, None)], "id int, line string, name string, prev string")
    got = {x["id"]: x["verdict"] for x in acceptance.judged(df, "line", "name", "prev").collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    want = {i: plain_verdict(line, name, prev) for i, line, name, prev in rows}
    assert {i: (got[i], want[i], rows[i]) for i in want if got[i] != want[i]} == {}
    assert set(want.values()) == {"accepted", "long", "short", "part", "unlike", "description"}


def test_first_accepted_is_the_loop(spark):
    r = random.Random(3)
    rows = [(r.randrange(12), i, r.choice("abcd"), r.random() < 0.3) for i in range(300)]
    want = []
    for g in range(12):
        taken = []
        for _, i, n, ok in (x for x in rows if x[0] == g):
            if ok and n not in taken and len(taken) < 2:
                taken.append(n)
                want.append((g, n, i, len(taken)))
    df = spark.createDataFrame([*rows, (99, 1, None, True)], "g int, i int, n string, ok boolean")
    out = acceptance.first_accepted(df, ["g"], "n", "i", F.col("ok"))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


LONG = "The old man of the sea came to the town and it was his last day there, "


def test_story_and_complement(spark):
    one = lambda t, *o: spark.createDataFrame([(t,)], "t string").select(paragraphs.story(F.col("t"), *[F.lit(x) for x in o]).alias("s")).first()["s"]
    a, b = LONG + "where cults had battled for decades.", "Her thoughts on signature coins were never written down by anyone who knew better than this, or so people say."
    assert tuple(one(f"NAME\n\n{b}\n \n{a}\n")) [0] == f"{a} {b}" and one(f"{b}\n\n{a}")["parts"] == 2
    assert one(f"{a}\n\n{a} Again.")["parts"] == 1  # the runner-up says the same
    assert one(f"{a}\n{b}")["story"] == f"{a} {b}"  # lines, where no empty line parts the text
    assert one(f"{a}\n\n{b}", "CULTS")["story"] == b  # a paragraph with another field's text is none
    assert one("") is None and one(None) is None and one("short\n\nTHE WHOLE " + "LOUD " * 40) is None
    rows = [(1, 0, a), (1, 1, b), (2, 5, a), (2, 4, a), (3, 0, "short"), (4, 0, None)]
    got = paragraphs.best_of_groups(spark.createDataFrame(rows, "g int, i int, t string"), ["g"], "t", "i", paragraphs.score(F.col("t")))
    assert sorted((x.g, x.story, x.parts) for x in got.collect()) == [(1, f"{a} {b}", 2), (2, a, 1)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_strategies(spark):
    def shaky(s):
        if "bad" in s:
            raise ValueError("no good")
        return s[::-1]

    known = strategies.registry([*strategies.LEVELS.values(), strategies.Strategy("reversed", [lambda c: F.concat(c, F.lit("! "))], shaky)])
    rows = [(0, "a  b", "plain"), (1, "GOIN 1 ●\nsantiy", "basic"), (2, " gain gain I dice, fig vet BY MADNESS", "enhanced"), (3, "abc", "reversed"), (4, "bad", "reversed"), (5, "bad  x", "nobody"), (6, None, "basic"), (7, "bad  y", None), (8, "stealthh", "advanced")]
    df = spark.createDataFrame(rows, "i int, t string, s string")
    got = {x.i: tuple(x.r) for x in df.select("i", strategies.run(F.col("t"), F.col("s"), known).alias("r")).collect()}
    assert got[0] == ("a b", "plain", None) and got[1] == ("gain 1 green dice\nsanity", "basic", None)
    assert got[2] == ("gain 1 dice, FUELED BY MADNESS", "enhanced", None)
    assert got[3] == ("cba!", "reversed", None) and got[4] == ("", "reversed", "ValueError: no good")
    assert got[5] == ("bad x", "plain", None) and got[6] == ("", "basic", None) and got[7] == ("bad y", "plain", None)
    assert got[8] == ("stealth", "advanced", None)
    other = df.where("i = 5").select(strategies.run(F.col("t"), F.col("s"), known, "reversed").alias("r")).first()["r"]
    assert other["error"] == "ValueError: no good"
    winners = df.select(strategies.for_category(F.col("s"), {"plain": "basic"}).alias("w")).collect()
    assert [w["w"] for w in winners][:2] == ["basic", None]
    with pytest.raises(ValueError):
        strategies.registry([known["plain"], known["plain"]])


def test_sort_states(spark):
    names = ["b", "A", None, "a", "B", "éa", "Z", "e"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    order = lambda s: [x["i"] for x in df.orderBy(*ranking.toggled(F.lit(s).cast("string"), F.col("n"), F.col("i"))).collect()]
    assert order("asc") == [2, 1, 3, 0, 4, 7, 5, 6] and order("desc") == [6, 5, 7, 0, 4, 1, 3, 2] and order(None) == list(range(8))
    states = spark.createDataFrame([("asc",), ("desc",), (None,)], "s string").select(ranking.next_state(F.col("s")).alias("s")).collect()
    assert [s["s"] for s in states] == ["desc", None, "asc"]


def test_work_list(spark, tmp_path):
    for at in ["s1/characters/ann/front.jpg", "s1/characters/ann/front.webp", "s1/characters/bob/bob.zip", "s1/characters/cy/notes.txt", "s1/characters/cy/old/front.jpg", "s1/stray/front.jpg", "s1/index.json", "s2/dee/back.jpeg", "s2/ann/x.txt", "s3/characters/readme.md", "s3/eve/front.jpg"]:
        path = tmp_path / "data" / at
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    root = str(tmp_path / "data")
    listed = worklist.work_list(spark, root)
    assert sorted(map(tuple, listed.collect())) == [("s1", "ann", "s1/characters/ann", "front.webp", None, False), ("s1", "bob", "s1/characters/bob", None, None, True), ("s2", "dee", "s2/dee", None, "back.jpeg", False)]
    assert re.search(r"ReadSchema: struct<path:string>|FileScan binaryFile \[path#\d+\]", listed._jdf.queryExecution().executedPlan().toString())
    assert [r.folder for r in worklist.work_list(spark, "file:" + root, "s2").collect()] == ["s2/dee"]
    assert [r.folder for r in worklist.work_list(spark, root, entity="ANN").collect()] == ["s1/characters/ann"]
    assert [r.folder for r in worklist.work_list(spark, root, "s2", "ann").collect()] == ["s2/ann"]
    assert worklist.work_list(spark, root, entity="nobody").collect() == []


def test_variants(spark):
    docs = ['{"z":1,"name":"Zoë \\"x\\"","location":"Rome, Italy"}', '{"location":{"original":"Rome","parsed":{"city":"Rome","country":null}}}', '{"location":7}', "[1,{}]", "nonsense", None, '"s"', "null", '{"location":{"original":["no"]}}', "{}"]
    v = variants.parsed(F.col("t"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(variants.kind(v), variants.kind(F.try_variant_get(v, "$.location", "variant")), variants.fields(v, "$.location").alias("f"), variants.written(v, ["name", "z"])).collect()]
    assert [g[0] for g in got] == ["object", "object", "object", "array", None, None, "string", "null", "object", "object"]
    assert [g[1] for g in got] == ["string", "object", "number", None, None, None, None, None, "object", None]
    assert tuple(got[0][2]) == ("Rome, Italy", None, None) and tuple(got[1][2]) == ("Rome", "Rome", None) and tuple(got[2][2]) == (None, None, None) == tuple(got[8][2])
    assert got[0][3] == '{"name":"Zoë \\"x\\"","z":1,"location":"Rome, Italy"}' and got[9][3] == "{}" and got[7][3] == "null"
    assert all(json.loads(g[3]) == json.loads(t) for g, t in zip(got, docs, strict=True) if g[3] is not None)


def test_gate_queries_on_all_parts(spark, sf_dir):
    from tessera.plans import record_queries

    rows = record_queries.gate_verdicts(spark, sf_dir).collect()
    assert [r.verdict for r in rows] == [plain_verdict(r.line, r["name"], r.before) for r in rows]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/part.parquet").count() and len({r.verdict for r in rows}) > 3
    brands = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    want = {}
    for r in sorted(rows, key=lambda r: r.p_partkey):
        taken = want.setdefault(brands[r.p_partkey], [])
        if r.verdict == "accepted" and len(taken) < 2 and r["name"] not in [n for n, _ in taken]:
            taken.append((r["name"], r.p_partkey))
    got = record_queries.gated_names(spark, sf_dir).collect()
    assert sorted((r.p_brand, r["name"], r.p_partkey, r["rank"]) for r in got) == sorted((b, n, p, i + 1) for b, found in want.items() for i, (n, p) in enumerate(found))


def test_level_statistics(spark):
    from tessera.functions import statistics

    texts = ["When attacking, gain 2 green dice. Reroll 1 die. Heal 1 wound and 2 stress. Reduce wounds and sanity by 1.", "nothing", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", statistics.level_statistics(F.col("t")))
    got = [r.s for r in df.orderBy("i").collect()]
    assert tuple(got[0]) == (2, 0, 1.5, 2.5, 1.0, 66.67, 2, 1.5, 1.5, True, ["when attacking"], 1, "standard", True, 1, 2, True, 1, 1, True)
    assert len(got[0]) == 20 and tuple(got[1]) == tuple(got[2]) == (0, 0, 1.5, 1.5, 0.0, 0.0, 0, 1.5, 1.5, False, [], 0, None, False, 0, 0, False, 0, 0, False)
    assert got[3] is None
    none = F.lit(None).cast("array<struct<level:int,description:string>>")
    row = df.limit(1).select(statistics.with_level(none, F.lit(2), F.lit(" x\n")).alias("a"), statistics.with_level(none, F.lit(5), F.lit("x")).alias("b"), statistics.has_levels(none).alias("c"), statistics.is_complete(none).alias("d"), statistics.has_power(F.lit(None).cast("array<string>"), F.lit("x")).alias("e")).first()
    assert [tuple(x) for x in row["a"]] == [(2, "x")] and row["b"] == [] and not (row["c"] or row["d"] or row["e"])


def test_statistics_search_a_text_once(spark, sf_dir):
    from tessera.plans import record_queries

    plan = record_queries.level_statistics(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan
    assert plan.count(r"gain\s+a\s+green\s+dice") == 1
