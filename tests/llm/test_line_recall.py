"""Line deduplication by edit similarity against brute force that knows no fingerprint."""

import random

import numpy as np

from tests.llm.helpers import documents
from tests.llm.test_group_operators import Groups, levenshtein
from tessera.llm import lines

PROSE = "market river window paper season bridge winter engine garden island silver letter forest number doctor castle summer yellow planet bottle".split()


def near_lines():
    """Lines of 6 to 60 words; of each, copies with one word in fifteen replaced and with single characters changed."""
    r, rows = random.Random(11), []
    for n in (6, 9, 12, 15, 20, 30, 60) * 3:
        base = [r.choice(PROSE) + str(r.randrange(1000)) for _ in range(n)]
        for kind in range(4):
            words = list(base)
            if kind < 2:
                for _ in range(max(1, n // 15)):
                    words[r.randrange(n)] = r.choice(PROSE)
            elif kind == 2:
                i = r.randrange(n)
                words[i] = "x" + words[i][1:]
            rows.append((len(rows), " ".join(words), "en", "s", 0))
    return rows


def brute_kept(rows, least_words):
    texts = [t for _, t, *_ in rows]
    groups = Groups(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if a and b and len(a.split()) >= least_words and len(b.split()) >= least_words and (a == b or lines.similar(a, b, 0.8)):
                groups.join(i, j)
    return {i for i in range(len(texts)) if groups.top(i) == i}


def test_edit_similarity_alone_links(spark, tmp_path):
    from tessera.llm import queries

    rows = near_lines()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_fuzzy_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == brute_kept(rows, 1)


def test_short_repeats_go(spark, tmp_path):
    from tessera.llm import queries

    text = "All rights reserved.\n\nMenu\n \nhome"
    rows = [(1, text, "en", "s", 0), (2, text + "\nALL  rights reserved.\nAll rights reserved!", "en", "s", 0)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op7_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (5, 0), 2: (7, 5)}


def test_pairs_are_compared_together_exactly(monkeypatch):
    from tessera.llm import _edits

    r, pairs = random.Random(5), []
    for n in (1, 7, 8, 30, 63, 64, 65, 200) * 25:
        a = [r.choice("abcdé 語\U0001f600") for _ in range(max(1, n + r.randint(-2, 2)))]
        b = list(a)
        for _ in range(r.randint(0, n // 3 + 1)):
            i = r.randrange(len(b))
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "é"])
            b = b or ["y"]
        pairs.append(("".join(a), "".join(b)))
    for table in (_edits.TABLE, 1 << 12):
        monkeypatch.setattr(_edits, "TABLE", table)
        assert lines.similar_pairs(pairs, 0.8).tolist() == [levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9) for a, b in pairs]
        short = [sorted(p, key=len) for p in pairs]
        assert _edits.distances(*map(list, zip(*short, strict=True))).tolist() == [levenshtein(a, b) for a, b in pairs]


def test_nominations_are_sent_in_few_rows(spark):
    import numpy as np

    rows = spark.createDataFrame([(i, " ".join(PROSE[(i * k) % 20] + str(i) for k in range(1, 9))) for i in range(500)], "_id long, text string").coalesce(1)
    none = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    got = lines.nominations(rows, 1, 4, none).collect()
    assert len(got) <= 4 and sum(len(r.keys) for r in got) == 8 * 500 * lines.BANDS
    for r in got:
        assert not r.popular and set(np.frombuffer(r.keys, np.uint64) % np.uint64(4)) == {r.part} and len(r.keys) == len(r.ids) == len(r.fps)
    first = np.sort(np.frombuffer(got[0].keys, np.uint64)[:16])
    common = [r for r in lines.nominations(rows, 1, 4, spark.sparkContext.broadcast(first)).collect() if r.popular]
    assert set(np.concatenate([np.frombuffer(r.keys, np.uint64) for r in common]).tolist()) == set(first.tolist())


def test_keys_of_very_many_lines_change_nothing(spark, monkeypatch):
    rows = [(i, f"this one sentence stands nearly unchanged in every document\n{' '.join(PROSE[(i * k) % 19] for k in range(1, 12))} {i % 50}\nsentence {i} of {i % 9} kinds", "en", "s", 0) for i in range(400)]
    df = documents(spark, rows)
    want = {tuple(r) for r in lines.drop_repeated_lines(df, report=True).collect()}
    monkeypatch.setattr(lines, "SHARD", 7)  # every key of the sample has more lines than are few
    assert {tuple(r) for r in lines.drop_repeated_lines(df, report=True).collect()} == want


def test_workers_give_memory_back(spark):
    import pyarrow as pa

    from tessera.llm import _tables

    def resident():
        return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmRSS")) // 1024

    def work(batches):
        list(batches)
        before = resident()
        held = [[str(i * k) * 40 for k in range(40)] for i in range(5000)]
        most, last = resident(), held[-1]
        del held  # the last text pins what the allocator has not given back
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (before, most, len(last))], ["before", "most", "n"])

    one = spark.range(1).coalesce(1)
    first = _tables.map_batches(one, work, "before long, most long, n long").first()
    again = _tables.map_batches(one, work, "before long, most long, n long").first()
    assert first.most > first.before + 40
    assert again.before < first.before + 40


def test_bands_decide_exactly(monkeypatch):
    from tessera.llm import _edits

    r, pairs = random.Random(9), []
    for n in (1, 7, 31, 63, 64, 65, 130, 300) * 20:
        a = [r.choice("abcdé 語\U0001f600") for _ in range(max(1, n + r.randint(-2, 2)))]
        b = list(a)
        for _ in range(r.randint(0, n // 3 + 1)):
            i = r.randrange(len(b))
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "éa"])
            b = b or ["y"]
        a, b = sorted(("".join(a), "".join(b)), key=len)
        pairs.append((a, b, max(len(b) - len(a), r.choice([0, 1, len(b) // 5, len(b) // 2, len(b)]))))
    a, b, allowed = (list(x) for x in zip(*pairs, strict=True))
    want = [levenshtein(x, y) <= k for x, y, k in pairs]
    rows, columns, allowed = np.array([len(x) for x in a]), np.array([len(x) for x in b]), np.array(allowed)
    for lanes, table in ((_edits.LANES, _edits.TABLE), (16, 1 << 12)):
        monkeypatch.setattr(_edits, "LANES", lanes)
        monkeypatch.setattr(_edits, "TABLE", table)
        got = np.zeros(len(pairs), bool)
        for own in _edits.batches(rows, columns, allowed):
            got[own] = _edits.within([a[k] for k in own], [b[k] for k in own], allowed[own])
        assert got.tolist() == want


def test_groups_held_by_another_go(spark):
    rows = [(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (3, 3), (4, 3), (5, 5), (6, 5), (5, 99), (6, 99), (7, 99)]
    groups = spark.createDataFrame(rows, "id long, group long")
    # 2 and 5 have all their lines in 1 and 99; 3 has one of its own
    assert {tuple(r) for r in lines.without_parts(groups).collect()} == {r for r in rows if r[1] in (1, 3, 99)}


def test_lines_with_single_spaces_are_read_where_they_stand():
    import pyarrow as pa

    from tessera.llm._words import spaced

    texts = ["one two three\nfour  five\n six seven", "", "A\tb c\n\n plain words here ", "x" * 120 + " y\n" + "z w " * 40]
    for some in (texts, ["all of it plain", "and this\ntoo"]):
        for _, _, data, bounds in lines.slices(pa.array(some)):
            words, first, last, _, _ = lines._lines(data, bounds, 1, False)
            found = [[x[s:e].tobytes() for s, e in zip(start, end, strict=True)] for x, start, end in (lines._spaced(words, first, last), spaced(words, first, last))]
            assert found[0] == found[1]
            blocks = [[tuple(map(np.ndarray.tobytes, x)) for x in lines._blocks(*how(words, first, last))] for how in (lines._spaced, spaced)]
            assert blocks[0] == blocks[1]
    assert lines._spaced(words, first, last)[0] is words.data
