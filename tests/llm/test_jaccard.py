"""Near duplicates by Jaccard similarity against brute force over all pairs, with no fingerprint in it."""

import random
import re

import pytest

from tests.llm.helpers import WORDS, documents, edge_documents
from tests.llm.test_group_operators import Groups
from tessera.llm import jaccard


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(texts):
    sets, groups = [brute_shingles(t) for t in texts], Groups(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                groups.join(i, j)
    return [groups.top(i) for i in range(len(texts))]


def near_rows():
    """Texts of which copies differ in single words, most of them by more than a SimHash radius of 4 admits."""
    r, rows = random.Random(8), []
    for base in range(12):
        words = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.choice((12, 40, 120, 400)))]
        for _ in range(5):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 60))):
                own[r.randrange(len(own))] = f"other{r.randrange(99)}"
            rows.append((100 + len(rows), " ".join(own), "en", "s", 0))
    return rows


@pytest.mark.parametrize("shard", [512, 3])
def test_jaccard_groups(spark, monkeypatch, shard):
    monkeypatch.setattr(jaccard, "SHARD", shard)
    rows = [r for r in edge_documents() if r[0] is not None] + near_rows()
    tops = brute_groups([r[1] for r in rows])
    least = {}
    for row, t in zip(rows, tops):
        least[t] = min(least.get(t, row[0]), row[0])
    got = jaccard.members(documents(spark, rows, clash=True)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((row[0], least[t]) for row, t in zip(rows, tops))
    assert len(set(tops)) < len(rows) - 30


def test_near_dedup_stage_leaves_no_near_copy(spark):
    import corpus_pipeline as pipeline

    rows = near_rows()
    kept = [r.text for r in dict(pipeline.STAGES)["near_dedup"](spark, documents(spark, rows), "").collect()]
    assert len(kept) == len(set(brute_groups([r[1] for r in rows])))


def test_fingerprints_nominate_without_bands(spark, monkeypatch):
    """Copies that lack the last of 400 words are within the radius; bands, which are switched off here, are not all that finds them."""
    monkeypatch.setattr(jaccard, "_bands", lambda found: [])
    r, rows = random.Random(3), []
    for base in range(8):
        words = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(400)]
        rows += [(2 * base, " ".join(words), "en", "s", 0), (2 * base + 1, " ".join(words[:-1]), "en", "s", 0)]
    got = jaccard.members(documents(spark, rows)).select("doc_id", "component_id").collect()
    linked = sum(x["doc_id"] != x["component_id"] for x in got)
    assert len(got) == 16 and linked >= 7
    assert all(x["component_id"] == x["doc_id"] - x["doc_id"] % 2 for x in got if x["doc_id"] != x["component_id"])
