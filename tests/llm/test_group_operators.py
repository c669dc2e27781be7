"""Operators that link rows, and the pipeline, against brute force: neighbours, lines, SimHash, components, stages."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from pyspark.sql import functions as F

import tessera.llm.lines as lines_module
from tests.llm.helpers import documents, edge_documents, plain
from tessera.llm import components, lines, neighbours, simhash
from tessera.llm._words import mix, slices


class Groups:
    def __init__(self, items):
        self.root = {x: x for x in items}

    def top(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        x, y = sorted((self.top(a), self.top(b)))
        self.root[y] = x


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 350)] + [(400, i) for i in range(401, 430)] + [(None, 1), (7, 7)]
    want = Groups(x for link in links for x in link if x is not None)
    for a, b in links:
        if a is not None:
            want.join(a, b)
    got = dict(plain(components.connected_components(spark.createDataFrame(links, "a long, b long"))))
    assert set(got) == {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert all(got[x] == want.top(x) for x in got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- op8


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(rows, radius=4):
    fps = {i: brute_fingerprint(t) for i, (_, t, *_) in enumerate(rows)}
    groups = Groups(fps)
    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and rows[i][0] is not None and rows[j][0] is not None:
                groups.join(i, j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[groups.top(i)] = min(least.get(groups.top(i), row[0]), row[0])
    by_print = {fps[i]: least[groups.top(i)] for i, row in enumerate(rows) if row[0] is not None}
    return sorted(((row[0], f"{fps[i]:016x}", by_print.get(fps[i])) for i, row in enumerate(rows)), key=str)


def test_near_duplicates(spark, sf_dir):
    assert plain(simhash.near_duplicates(documents(spark, clash=True))) == brute_near(edge_documents())
    assert simhash.near_duplicates(documents(spark, rows=[])).collect() == []
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_near(rows)


@pytest.mark.parametrize("bucket, shard, count", [(64, 1024, 0), (1, 7, 10**9), (4, 40, 0)])
def test_near_links(spark, bucket, shard, count):
    r = np.random.default_rng(1)
    values = set()
    for base in r.integers(0, 1 << 62, 40).tolist():
        for _ in range(int(r.integers(1, 30))):
            values.add(base ^ sum(1 << int(k) for k in r.choice(63, r.integers(0, 5), replace=False)))
    values = sorted(values)
    want = Groups(range(len(values)))
    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= 4:
                want.join(i, j)
    links = simhash.near_links(spark.createDataFrame(list(zip(values, range(len(values)))), "fp long, id long"), 4, count or len(values), bucket, shard)
    got = dict(plain(components.connected_components(links)))
    assert [got.get(i, i) for i in range(len(values))] == [want.top(i) for i in range(len(values))]


def test_tree_search_finds_all():
    r = np.random.default_rng(2)
    values = np.unique(r.integers(0, 1 << 16, 500).astype(np.uint64))
    found = {(node, int(q)) for node, near in simhash.BKTree(values).search(values, 3) for q in near}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}


def test_one_of_each(spark):
    rows = edge_documents()
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(documents(spark, clash=True)).collect()]
    near = {(d, f): c for d, f, c in brute_near(rows)}
    want = {near[row[0], f"{brute_fingerprint(row[1]):016x}"] for row in rows}
    assert sorted(d for d, _ in got) == sorted(want)


# ---- op7


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abé ") for _ in range(r.randint(0, 60)))
        b = list(a)
        for _ in range(r.randint(0, 14)):
            kind = r.randrange(3)
            if kind == 0 and b:
                b.pop(r.randrange(len(b)))
            elif kind == 1:
                b.insert(r.randint(0, len(b)), r.choice("abc"))
            elif b:
                b[r.randrange(len(b))] = r.choice("abx")
        b = "".join(b)
        distance = levenshtein(a, b)
        assert lines.similar(a, b, 0.8) == (distance <= int(max(len(a), len(b)) * 0.2 + 1e-9))
        assert lines._bound(a, b, 12) >= distance


def line_rows():
    r = random.Random(4)
    names = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    fox = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the wood today again and again over the hills and far away".split()
    rows = edge_documents()
    for i in range(100, 220):
        words = list(fox if r.random() < 0.6 else [r.choice(names) for _ in range(5)] * 3)
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(names)
        text = " ".join(words) + "\nshort line\n" + rows[r.randrange(4)][1].split("\n")[0].upper() + "  "
        rows.append((i, text, "en", "s", len(text)))
    return rows


def brute_lines(rows):
    def words(line):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))

    occurrences = [(d, n, t, " ".join(words(line))) for d, t, *_ in rows if d is not None and t is not None for n, line in enumerate(t.split("\n")) if len(words(line)) >= 5]
    texts = sorted({o[3] for o in occurrences})
    fps = {}
    for t in texts:
        ((_, _, data, bounds),) = slices(pa.array([t]))
        w, first, last, _, _ = lines._lines(data, bounds, 1)
        weight = np.minimum(w.end - w.start, 15)
        bits = (mix(w.hash ^ np.uint64(0xA4093822299F31D0))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        fps[t] = sum(1 << b for b in range(64) if 2 * int((bits[:, b] * weight.astype(np.uint64)).sum()) > weight.sum())
        assert fps[t] == int(lines._simhashes(w, first, last)[0])
    groups = Groups(texts)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                groups.join(a, b)
    return occurrences, groups


@pytest.mark.parametrize("shard", [1024, 7])
def test_lines(spark, monkeypatch, shard):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines_module, "SHARD", shard)
    rows = line_rows()
    occurrences, groups = brute_lines(rows)
    keys = dict(spark.createDataFrame([(t,) for t in {r[1] for r in rows if r[1] is not None}], "t string").select("t", F.xxhash64("t")).collect())
    keep = {}
    for d, n, t, line in occurrences:
        keep[groups.top(line)] = min(keep.get(groups.top(line), (d, n, keys[t])), (d, n, keys[t]))
    gone = {}
    for d, n, t, line in occurrences:
        if keep[groups.top(line)] != (d, n, keys[t]):
            gone.setdefault((d, t), set()).add(n)
    want = []
    for d, t, *_ in rows:
        every = [] if t is None else t.split("\n")
        lost = gone.get((d, t), set())
        kept = "\n".join(x for i, x in enumerate(every) if i not in lost)
        want.append((d, len(every), len(lost), hashlib.sha256(kept.encode()).hexdigest()))
    assert plain(lines.drop_repeated_lines(documents(spark, rows, clash=True), least_words=5, radius=4, report=True)) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 100


def test_lines_keep_columns(spark):
    df = documents(spark, clash=True)
    got = lines.drop_repeated_lines(df)
    assert got.columns == df.columns and got.count() == df.count()
    assert lines.drop_repeated_lines(documents(spark, rows=[])).collect() == []


# ---- op2


def test_neighbours(spark):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(600, 7)).astype(np.float32)
    vectors[200:420] = vectors[3]
    vectors[500:560] = vectors[4] + r.normal(size=(60, 7)).astype(np.float32) * 0.001
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(700, None), (720, [0.0] * 7), (740, [1.0, None] + [0.0] * 5), (760, [float("nan")] + [1.0] * 6), (780, [1.0] * 6), (None, vectors[0].tolist()), (800, [float("inf")] * 7)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnsRenamed({}).repartition(3)).collect()
    assert {x.query_id for x in got} == set(range(0, 600, 20))
    exact = vectors.astype(np.float64)
    found = 0
    for q in range(0, 600, 20):
        own = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [x.rank for x in own] == list(range(1, 21))
        assert [(-x.score, x.vec_id) for x in own] == sorted((-x.score, x.vec_id) for x in own)
        scores = np.array([float(np.dot(exact[q], v)) for v in exact])
        assert all(abs(x.score - scores[x.vec_id]) < 1e-9 and x.vec_id != q for x in own)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(scores, 9)))[:20]
        found += len(set(best.tolist()) & {x.vec_id for x in own})
    assert found / (30 * 20) > 0.9


def test_repeated_ids_and_lengths(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (40, [1.0, 0.0, 0.0]), (41, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 rank", "2 cid", "'x' v", "3 list")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df).collect())
    one = [(20, 1, 3, 2.0), (20, 2, 20, 1.0), (20, 3, 20, 0.5)]
    assert got == sorted([*one, *one, (20, 1, 3, 1.0), (20, 2, 20, 0.5), (20, 3, 20, 0.5), (40, 1, 41, 1.0)])


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 5, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 5, 0.5)]
    assert neighbours.search(df.limit(0)).collect() == []
    assert neighbours.search(df.where("vec_id = 0")).collect() == []


# ---- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    near = brute_near(rows)
    assert len({c for *_, c in near}) == len(rows) > 0
    assert {d for d, *_ in plain(pipeline.run(spark, sf_dir))} == {d for d, _ in rows}


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline as pipeline

    names = {"score": "double", "ambiguous": "boolean", "lang_pred": "string", "__id": "int", "__key": "int", "__gone": "int", "hits": "int", "spans": "int", "items": "int"}
    docs = documents(spark).select("*", *[F.lit("1").cast(kind).alias(name) for name, kind in names.items()])
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert set(names) < set(docs.columns) and docs.count() > 3
        assert docs.where(" or ".join(f"cast({name} as string) not in ('1', '1.0', 'true') or {name} is null" for name in names)).count() == 0


@pytest.mark.parametrize("shard", [5, 64])
def test_groups_of_many_shards(spark, shard):
    from tessera.llm._groups import group_links

    r = random.Random(shard)
    values = [r.choice((0, 1000)) + r.randrange(40) for _ in range(90)] + list(range(5000, 5400, 40))
    rows = [(i % 2, i, v) for i, v in enumerate(values)]

    def compare(members, left):
        own, out = members.field("v").to_pylist(), []
        for i in range(len(own) if left is None else left):
            out += [(i, j) for j in range(i + 1 if left is None else left, len(own)) if abs(own[i] - own[j]) <= 3]
        a, b = zip(*out) if out else ((), ())
        return np.array(a, np.int64), np.array(b, np.int64)

    want = Groups(range(len(values)))
    for i, v in enumerate(values):
        for j in range(i):
            if (i - j) % 2 == 0 and abs(v - values[j]) <= 3:
                want.join(i, j)
    links = group_links(spark.createDataFrame(rows, "group int, id long, v int"), compare, shard)
    got = dict(plain(components.connected_components(links)))
    assert [got.get(i, i) for i in range(len(values))] == [want.top(i) for i in range(len(values))]


def test_pipeline_stages_on_edges(spark, sf_dir):
    import corpus_pipeline as pipeline

    for rows in (None, []):
        for _, stage in pipeline.STAGES:
            stage(spark, documents(spark, rows), sf_dir).collect()


def test_lines_by_shuffled_lists(spark, monkeypatch):
    from tessera.llm import _tables, lines

    rows = [(i, f"the same first line of all\nline number {i % 7} of this very document here\nonly {i * i * i} this", "en", "s", 0) for i in range(40)]
    df = documents(spark, rows, clash=True)
    want = plain(lines.drop_repeated_lines(df, report=True)), plain(lines.drop_repeated_lines(df))
    monkeypatch.setattr(_tables, "BROADCAST_ROWS", 0)
    assert (plain(lines.drop_repeated_lines(df, report=True)), plain(lines.drop_repeated_lines(df))) == want
