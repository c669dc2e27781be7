"""Reference tables from files, and ability levels against a plain reading of the lines."""

import json
import re

from tessera.functions import summaries
from tessera.operators import lookup, segment
from tessera.plans import lookup_queries
from tessera.sources import reference


def plain_levels(text):
    found, open_level = [], None
    for line in [*[x.strip() for x in text.split("\n")], "1. "]:
        numbered = re.match(r"(\d+)[.:)](?: |$)(.*)", line)
        if numbered or "instead" in line.lower():
            if open_level is not None and len(" ".join(open_level).split()) >= 3 and " ".join(open_level) not in found:
                found.append(" ".join(open_level))
            open_level = [numbered[2] if numbered else line]
        elif open_level is not None and line:
            open_level.append(line)
    return found[:4]


def test_ability_levels(spark, sf_dir):
    rows = [(1, "ARCANE MASTERY\n1. Gain one green dice.\nwhile attacking\n2) Gain two green dice.\nGain 3 black dice instead.\n4: Heal."), (2, None), (3, ""), (4, "1. a b c\n1. a b c")]
    got = {}
    for r in segment.levels(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {i: x for i, t in rows if (x := plain_levels(t or ""))}
    assert got[1] == ["Gain one green dice. while attacking", "Gain two green dice.", "Gain 3 black dice instead."]
    docs = lookup_queries.numbered_text(spark, sf_dir)
    want = sorted((d, i + 1, x) for d, t in docs.select("doc_id", "text").collect() for i, x in enumerate(plain_levels(t or "")))
    assert want and sorted(map(tuple, lookup_queries.ability_levels(spark, sf_dir).collect())) == want


def test_reference_files(spark, tmp_path):
    level = lambda n: {"level": n, "description": f"d{n}", "effect": None}
    (tmp_path / "powers.json").write_text(json.dumps([{"name": "Swift", "levels": [level(1)]}, {"name": "Tough", "levels": []}, {"name": "Swift", "levels": [level(1), level(2)]}]))
    assert sorted(map(tuple, reference.power_levels(spark, str(tmp_path / "powers.json")).collect())) == [("Swift", 1, "d1", None), ("Swift", 2, "d2", None)]
    (tmp_path / "traits.json").write_text(json.dumps({"character_traits": {"Lord Adam Benchley (7)": ["Swift"], "Adam": ["Tough", "Swift"], "Sister Beth": []}}))
    assert dict(map(tuple, reference.assignments(spark, str(tmp_path / "traits.json")).collect())) == {"adam": ["Tough", "Swift"], "beth": []}
    (tmp_path / "places.json").write_text(json.dumps({"regions": {"France": "Europe"}, "coordinates": {"PARIS": {"lat": 48.9, "lon": 2.4}}}))
    tables = reference.gazetteer(spark, str(tmp_path / "places.json"))
    assert {n: t.count() for n, t in tables.items()} == {"divisions": 0, "regions": 1, "states": 0, "coordinates": 1}
    (tmp_path / "result.json").write_text(json.dumps([{"name": "a", "score": 2.5}, {"name": "b", "category": "c"}]))
    assert sorted(map(tuple, reference.saved_results(spark, str(tmp_path / "result.json")).collect()), key=str) == [("a", None, 2.5, 0.0, ""), ("b", "c", 0.0, 0.0, "")]
    known = spark.createDataFrame([("p1", "Ann")], "id string, name string")
    assert dict(map(tuple, reference.speakers(spark.createDataFrame([("p1",), ("p27",)], "id string"), known).collect())) == {"p1": "Ann", "p27": "Speaker 27"}


def test_forced_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, a int")
    assert [r.id for r in lookup.pending(rows, ["a"]).collect()] == [1]
    assert lookup.pending(rows, ["a"], force=True).count() == 2
    assert rows.select(summaries.upgrades().alias("u")).first().u == []
