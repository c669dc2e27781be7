"""Column functions on small literals."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dice, facts, names, rules, scoring, similarity, text, tracks
from tessera.operators import builds, levels, merge, places, segment, vocabulary
from tessera.streaming.insanity import _step, final_insanity


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_rule_order(spark):
    assert one(spark, rules.literal, "I would isone | go") == "I woundld is one   go"
    assert one(spark, rules.bounded, "he wou would") == "he wound would"
    assert one(spark, rules.digit_context, "gain I green dice, I woun") == "gain 1 green dice, 1 wound"


def test_threshold_keeps_prefix(spark):
    assert one(spark, text.threshold_symbols, "at the insanity threshold") == "at the inred swirl"


def test_clean(spark):
    assert one(spark, text.clean, "  Gain 1 ● ~ \"now\"\n\nfreee ") == "Gain 1 green dice now free"
    assert one(spark, text.clean, "") == ""
    assert one(spark, text.clean, None) is None


def test_repeats(spark):
    assert one(spark, text.collapse_repeats, "you may you may gain gain it") == "you may gain it"


@pytest.mark.parametrize(
    "sentence, green, black, conversion, factor",
    [
        ("Gain a green dice when attacking.", 1, 0, 0, 1),
        ("When attacking, gain 2 green dice.", 2, 0, 0, 1),
        ("Gain 1 black dice.", 0, 1, 0, 1),
        ("You may count 1 Arcane (elder sign) as success.", 0, 0, 1, 1),
        ("Count any number of elder signs as 2 successes.", 0, 0, 999, 2),
        ("Heal 1 stress for each elder sign you count as a success.", 0, 0, 999, 1),
        ("Move twice.", 0, 0, 0, 1),
    ],
)
def test_facts(spark, sentence, green, black, conversion, factor):
    row = spark.createDataFrame([(sentence,)], "t string").select(*facts.all_facts(F.col("t"))).first()
    assert (row.green, row.black, row.conversion, row.factor) == (green, black, conversion, factor)


def test_other_facts(spark):
    got = lambda s: spark.createDataFrame([(s,)], "t string").select(*facts.all_facts(F.col("t")), facts.conditions(F.col("t")).alias("c")).first()
    r = got("Heal 2 wounds and 1 stress; reroll 3 dice when attacking a target in your space")
    assert (r.wounds_healed, r.stress_healed, r.rerolls, r.reroll_kind) == (2, 1, 3, "standard")
    assert r.c == ["when attacking", "when attacking target in your space"]
    r = got("Reduce wounds and sanity by 2. 1 free reroll. 2 additional actions to run.")
    assert (r.wound_reduction, r.sanity_reduction, r.rerolls, r.reroll_kind, r.actions, r.action_kind) == (2, 2, 1, "free", 2, "run")


#: Effects of powers by name, level and what they are known to add to the base roll.
GOLDEN = [
    ("Arcane Mastery", 1, 0, 0, 1, 2.0, 33.33, 0, 1.5),
    ("Arcane Mastery", 2, 0, 0, 999, 2.0, 33.33, 0, 1.5),
    ("Brawling", 1, 1, 0, 0, 2.0, 33.33, 1, 1.5),
    ("Marksman", 2, 2, 0, 0, 2.5, 66.67, 2, 1.5),
    ("Stealth", 1, 1, 0, 0, 2.0, 33.33, 1, 1.5),
    ("Toughness", 1, 0, 1, 0, 2.0, 33.33, 1, 2.0),
]


@pytest.mark.parametrize("row", GOLDEN)
def test_golden_impact(spark, row):
    _, _, green, black, conversion, enhanced, percent, most, risk = row
    columns = dice.impact(F.lit(green), F.lit(black), F.lit(conversion), F.lit(1))
    got = spark.range(1).select(*columns).first()
    # one elder sign at most is converted from half an expected one
    assert round(got.enhanced, 4) == enhanced if conversion or green or black else 1.5
    assert (round(got.percent, 2), got.max_increase, round(got.risk, 4)) == (percent, most, risk)


def test_chances():
    assert dice.chances("black").success == dice.chances("green").success == 0.5
    assert dice.chances("black").tentacle == 0.5 and dice.chances("green").tentacle == 0
    assert round(dice.chances("black").elder_sign, 4) == 0.1667 and dice.chances("green").elder_sign == 0.5
    assert round(dice.chances("black", "faces").tentacle, 4) == 0.3333
    with pytest.raises(ValueError):
        dice.chances("black", "other")


@pytest.mark.parametrize("at, n, after", [(4, 3, 5), (0, 2, 2), (19, 5, 20), (20, 5, 21), (21, 1, 21)])
def test_advance(spark, at, n, after):
    assert spark.range(1).select(tracks.advance(F.lit(at), F.lit(n)).alias("r")).first()["r"] == after == _step(at, n)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_fold_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr("tessera.streaming.insanity.PIECE", piece)
    rows = [(k, f"2024-01-{1 + i // 40:02d} {i % 24:02d}:00:00", i, (i * 7 + k) % 3) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, ts string, i int, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    for k, ts, i, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[k] = _step(want.get(k, 0), n)
    out = final_insanity(df, "k", "ts", "i", "n")
    assert {r.k: r.insanity for r in out.collect()} == want
    hot = [(1, "2024-01-01 05:00:00", i, (i * i) % 2) for i in range(40)]
    slot = 0
    for *_, n in hot:
        slot = _step(slot, n)
    one_hour = spark.createDataFrame(hot, "k int, ts string, i int, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert final_insanity(one_hour, "k", "ts", "i", "n").first()["insanity"] == slot


def test_playstyle(spark):
    style = lambda s, t, w, h, r: spark.range(1).select(tracks.playstyle(*map(F.lit, (s, t, w, h, r))).alias("r")).first()["r"]
    assert [style(3.0, 0.5, 0, 0, 0), style(1.5, 1.5, 2, 1, 0), style(1.0, 2.0, 0, 0, 1), style(1.0, 2.0, 0, 0, 0)] == ["offensive", "defensive", "utility", "balanced"]


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), (None, "x"), ("Kitten ", "kitten")], "a string, b string")
    got = [r[0] for r in df.select(similarity.ratio(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 4) for x in got] == [0.6667, 1.0, 0.0, 1.0]
    assert [round(r[0], 2) for r in df.select(similarity.indel(F.col("a"), F.col("b"))).collect()] == [66.67, 100.0, 0.0, 92.31]


def test_scores(spark):
    df = spark.createDataFrame([("Paris, France", "paris, france"), ("Rome, france", "paris, france"), (None, "x"), ("x", None)], "f string, t string")
    assert [r[0] for r in df.select(scoring.place_score(F.col("f"), F.col("t"))).collect()] == [100.0, 80.0, 0.0, 50.0]
    assert one(spark, scoring.mechanics_score, "Gain 2 dice instead, then heal 1 2 3 4") == 10 + 15 + 10 + 5 + 15


def test_issues(spark):
    assert one(spark, scoring.description_issues, "word Word word word word word HELLO   x") == ["capitals", "whitespace", "unfinished", "repeated"]
    assert one(spark, scoring.frequent_words, "bbbb aaaa bbbb aaaa bbbb aaaa bbbb aaaa the the the the") == ["bbbb", "aaaa"]
    assert one(spark, scoring.frequent_words, "") == []


def test_merge(spark):
    old = spark.createDataFrame([(1, "ab", "x"), (2, "", "y")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "abc", "z"), (3, "q", None)], "k int, a string, b string")
    got = sorted(map(tuple, merge.merge(old, new, "k", prefer_longer=["a"], prefer_old=["b"]).select("k", "a", "b").collect()))
    assert got == [(1, "abc", "x"), (2, None, "y"), (3, "q", None)]


def test_places(spark):
    df = spark.createDataFrame([("Kyoto, Japan",), ("Salem, Ohio",), ("a, b, c",), ("UNKNOWN",), ("a, b, c, d",), (None,)], "p string")
    got = [tuple(r)[1:] for r in places.parse(df, "p", spark.createDataFrame([("Ohio", "USA")], "state string, country string")).collect()]
    assert sorted(got, key=str) == sorted([("Kyoto", None, "Japan"), ("Salem", "Ohio", "USA"), ("a", "b", "c"), (None, None, None), (None, None, None), (None, None, None)], key=str)


def test_levels(spark):
    doc = "Title\n1. Gain one green dice\nwhen attacking\n2) Gain two green dice\nInstead gain three of them now\n4. no"
    got = [tuple(r) for r in segment.levels(spark.createDataFrame([(5, doc), (6, None)], "id long, text string"), "id").collect()]
    assert got == [(5, 1, "Gain one green dice when attacking"), (5, 2, "Gain two green dice"), (5, 3, "Instead gain three of them now")]


def test_vocabulary(spark):
    entries = ["Arcane Mastery", "Brawling"]
    assert one(spark, lambda t: vocabulary.exact_layers(t, entries), "my brawling skill") == "Brawling"
    assert one(spark, lambda t: vocabulary.containing_rule(t, [("arcane", "Arcane Mastery")]), "the ARCANE") == "Arcane Mastery"
    got = vocabulary.fuzzy(spark.createDataFrame([("Brawlng",), ("zzzz",), (None,)], "l string"), "l", entries).collect()
    assert sorted((r.l or "", r.match) for r in got) == [("", None), ("Brawlng", "Brawling"), ("zzzz", None)]


def test_totals(spark):
    rows = [(1, 2, 0, 1, 1, 0, False), (1, 5, 1, 0, 2, 3, True)]
    got = builds.totals(spark.createDataFrame(rows, "e int, green int, black int, rerolls int, wounds int, stress int, replaces boolean"), "e").first()
    assert (got.green, got.black, got.rerolls, got.wounds_active, got.wounds_listed, got.stress_listed) == (2, 3, 1, 1, 3, 3)


def test_cards(spark):
    from tessera.functions import cards

    assert one(spark, cards.name_line, "5 LORD ADAM\nsome text\nMISS BEL\nLORDS") == "LORD ADAM"
    assert one(spark, cards.name_line, "nothing here") is None
    assert one(spark, cards.motto, 'NAME\n"Shoot first, ask never."') == "Shoot first, ask never."
    assert one(spark, cards.motto, "NAME\nShoot first and\nask questions never") == "Shoot first and ask questions never"
    assert one(spark, cards.motto, "NAME\nxyz") is None
    long = "It was the most curious of warnings, and his fellow investigators battled the cults for decades without rest."
    assert one(spark, cards.story, "SHORT\n\n" + long + "\n\nYOUR TURN") == long
    assert one(spark, cards.story, "short") is None
    assert one(spark, cards.unique_sentences, "The cat sat down. A dog ran off! the cat sat down.") == "The cat sat down. A dog ran off!"
    assert one(spark, cards.domain_rewrite, "You goin attakk, but attack") == "You goin attack, but attack"
    assert one(spark, cards.domain_rewrite, None) is None
    issues = lambda d, e: spark.createDataFrame([(d, e)], "d string, e string").select(cards.consistency_issues(F.col("d"), F.col("e"), F.lit(0), F.lit(0)).alias("r")).first()["r"]
    assert issues("Roll green dice; perform 1 free attack", "none") == ["green dice", "free action"]
    assert issues("Roll green dice when hit", "") == []


def test_sources(spark, tmp_path):
    import json

    from tessera.operators.index import facets, substring_search
    from tessera.sources import entities, rule_files, sinks

    def put(path, value):
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps(value) if not isinstance(value, str) else value)

    put(tmp_path / "in/s1/characters/ann/character.json", {"id": "ann", "name": "Ann", "location": {"original": "Oslo, Norway", "parsed": {"city": "Oslo"}}, "common_powers": ["A", "B"], "special_power": {"name": "P", "levels": [{"level": 1, "description": "d"}]}})
    put(tmp_path / "in/s2/bob/character.json", {"name": "Bob", "location": "Rome", "common_powers": 7, "special_power": "Q"})
    put(tmp_path / "in/s2/eve/character.json", "{broken")
    got = {r.id: r for r in entities.read_entities(spark, f"{tmp_path}/in/*/characters/*/*.json", f"{tmp_path}/in/*/[be]*/*.json").collect()}
    assert (got["ann"].season, got["ann"].place.parsed.city, got["ann"].common_powers, got["ann"].special_power["levels"][0].level) == ("s1", "Oslo", ["A", "B"], 1)
    assert (got["bob"].season, got["bob"].place.original, got["bob"].common_powers, got["bob"].special_power.name) == ("s2", "Rome", [], "Q")
    assert got["eve"]._corrupt_record is not None
    df = entities.named(entities.read_entities(spark, f"{tmp_path}/in/*/characters/*/*.json"))
    assert [(r.season, r.character_count) for r in sinks.season_documents(df).collect()] == [("s1", 1)]
    index = facets(df, {"name": F.col("name"), "city": F.col("place.parsed.city")}, "id")
    sinks.write_postings(index, f"{tmp_path}/index")
    assert [r.id for r in substring_search(spark.read.parquet(f"{tmp_path}/index"), " OSL").collect()] == ["ann"]
    assert substring_search(index, "  ").collect() == []
    assert rule_files.ordered_rules(tmp_path / "none.toml") == []
    (tmp_path / "r.toml").write_text('[a.b]\n"x" = "y"\n"w" = "z"\n')
    assert rule_files.ordered_rules(tmp_path / "r.toml", "a", "b") == [("x", "y"), ("w", "z")]
    (tmp_path / "r.json").write_text(json.dumps({"corrections": {"a": "1", "bbb": "2", "cc": "3"}, "priority": ["cc"]}))
    assert rule_files.prioritised_rules(tmp_path / "r.json") == [("cc", "3"), ("bbb", "2"), ("a", "1")]
    before = spark.createDataFrame([(1, "a")], "k int, v string")
    after = spark.createDataFrame([(1, "b")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.rewrite(before, after, f"{tmp_path}/new", dry_run=True).collect()) == [(1, "a", "-"), (1, "b", "+")]
    assert not (tmp_path / "new").exists()


def test_stream(spark, tmp_path):
    from tessera.streaming.insanity import stream_insanity, windowed_counts

    schema = "k long, ts timestamp, i long, n int"
    rows = [(k, f"2024-01-01 0{i}:00:00", i, i % 3 + k) for k in range(2) for i in range(6)]
    spark.createDataFrame(rows, "k long, ts string, i long, n int").selectExpr("k", "cast(ts as timestamp) ts", "i", "n").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = stream_insanity(source, "k", "ts", "i", "n").writeStream.format("memory").queryName("slots").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.k: (r.insanity, r.events) for r in spark.table("slots").collect()}
    want = {}
    for k, _, _, n in rows:
        want[k] = _step(want.get(k, 0), n)
    assert got == {k: (v, 6) for k, v in want.items()}
    assert windowed_counts(spark.read.parquet(f"{tmp_path}/in"), "ts", "k").count() == 12


@pytest.mark.parametrize(
    "figures, sentence",
    [
        ((2, 1, 0, 1, 0, "attack"), "Adds 2 green dice + 1 black dice"),
        ((0, 0, 999, 2, 1, "run"), "Counts any elder signs as 2 successes each. Adds 1 free run per turn"),
        ((0, 0, 3, 1, 2, "move"), "Counts 3 elder sign(s) as success(es). Adds 2 free moves per turn"),
        ((0, 0, 0, 1, 0, "attack"), names.NO_EFFECT),
    ],
)
def test_effect_sentence(spark, figures, sentence):
    columns = [F.lit(x) for x in figures]
    assert spark.range(1).select(names.effect_sentence(*columns)).first()[0] == sentence


@pytest.mark.parametrize("name, key, plain", [("Lord Adam Benchley (7)", "adam", "adam benchley 7"), ("Adam", "adam", "adam"), ("Prof. O'Hara", "prof.", "ohara"), ("", "", ""), (None, None, None)])
def test_names(spark, name, key, plain):
    assert one(spark, names.name_key, name) == key
    assert one(spark, names.plain_name, name) == plain


def test_references(spark):
    found = one(spark, names.references, "Al Capone (20), nobody, Lord Adam Benchley (7)")
    assert [tuple(r) for r in found] == [("Al Capone", 20), ("Lord Adam Benchley", 7)]
    assert one(spark, names.references, "") == []
    assert one(spark, names.references, None) is None


@pytest.mark.parametrize("motto, cleaned", [("-| Shoot first ~ ask never |", "Shoot first ask never"), ("Life is is certain ab", "Life is certain"), ('"4 never ask"', '"I never ask"'), ("Instead. Make peace", "Instead, I make peace"), ("", ""), (None, None), ('id ~ "Trust no one"', '"Trust no one"'), ("xx yy. 'Never ask", "'Never ask"), ("Quite a long piece in front of it: \"Never ask", "Quite a long piece in front of it: \"Never ask"), ("zz 'ab' \"Ask first", '"Ask first')])
def test_motto(spark, motto, cleaned):
    assert one(spark, names.clean_motto, motto) == cleaned


def test_specs(spark):
    specs = spark.createDataFrame([("a:1",), ("a:9",), ("b:1",), ("a",), ("a:x",), (None,), ("a:1:2",)], "spec string")
    known = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1)], "name string, level int")
    found = {r["spec"]: r["status"] for r in levels.resolve(specs, "spec", known).collect()}
    assert found == {"a:1": "found", "a:9": "unknown level", "b:1": "unknown name", "a": "malformed", "a:x": "no level", None: "malformed", "a:1:2": "no level"}


def test_best_extraction(spark):
    rows = spark.createDataFrame([("p", 1, 1, "long text one"), ("p", 1, 2, "long text two"), ("p", 2, 3, "x"), ("p", 3, 4, None)], "power string, level int, seq int, t string")
    best = levels.best_extraction(rows, "power", F.col("level"), "t", ["seq"], names.valid_extraction(F.col("t")))
    assert sorted(map(tuple, best.collect())) == [("p", 1, "long text one"), ("p", 2, "Not found"), ("p", 3, "Not found"), ("p", 4, "Not found")]
