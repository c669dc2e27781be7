"""Operators on single texts against brute force: licences, tokens, repeats, contamination, language, quality."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, documents, edge_documents, plain
from tessera.llm import decontaminate, langid, licences, packing, quality, substrings, tokens


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, clash=True)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, rows=[])


def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- op1


def test_licences_edges(spark, docs, empty):
    assert licences.scan(empty).collect() == []
    assert licences.scan(docs).collect() == []
    mit = "x y z\n" + licences.TEMPLATES[2][1].replace("free of charge", "without cost")
    rows = [(1, mit, None, None, 0), (1, mit, None, None, 0), (2, "RELEASED under the -- MIT license!!", None, None, 0), (3, None, None, None, 0), (4, "mit", None, None, 0)]
    got = plain(licences.scan(documents(spark, rows)))
    assert [r[:4] for r in got] == [(1, -1, None, "MIT"), (1, -1, None, "MIT"), (1, 1, 1, "MIT"), (1, 1, 1, "MIT"), (2, 0, 0, "MIT")]
    assert got[-1][4] == 1.0


def test_wrapped_notice_in_a_longer_text(spark, tmp_path, monkeypatch):
    import textwrap

    import duckdb

    notice = "\n".join(textwrap.wrap(licences.TEMPLATES[2][1], 60))
    prose = "".join(f"Line {i} of a manual\ngoes on w{i} x{i} y{i}\n" for i in range(90))
    rows = [(1, f"{prose}\n \n{notice}\n\n\n{prose}", None, None, 0), (2, notice, None, None, 0), (3, f"\n\n{notice}\n\n", None, None, 0)]
    df = documents(spark, rows)
    got = plain(licences.scan(df))
    n = notice.count("\n")
    whole = [(1, -3, None), (1, 182, 182 + n), (2, -1, None), (2, 0, n), (3, -1, None), (3, -3, None), (3, 2, 2 + n)]
    assert sorted((r[:3] for r in got), key=str) == sorted(whole, key=str) and {r[3:] for r in got} == {("MIT", 1.0)}
    df.write.parquet(f"{tmp_path}/documents")
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert sorted(connection.sql(licences.oracle()).fetchall(), key=str) == got
    monkeypatch.setattr(licences, "BROADCAST_BIGRAMS", 0)
    assert plain(licences.scan(df)) == got


def plain_runs(text, least):
    """(first line, last line, licence, dice) of runs of lines, by a loop over the lines for each long template."""
    split = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).split()
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    known = [(name, split(t)) for name, t in licences.TEMPLATES]
    lines = [(i, w) for i, w in enumerate(map(split, text.split("\n"))) if w]
    spans = set()
    for _, words in known:
        if len(words) < licences.LONG:
            continue
        shape = pairs(words)
        for way in (False, True):
            total, begin, best, end = 0, 0, 0, -1

            def close(upto):
                if end > begin and best >= least * len(shape) / 2 - 1e-9:
                    spans.add((begin, end))
                return 0, upto, 0, -1

            for k, (_, w) in enumerate(lines):
                own = pairs((lines[k - 1][1][-1:] if k else []) + w)
                if way and tuple(words[:2]) in own:
                    total, begin, best, end = close(k)
                total += 2 * len(own & shape) - least * len(own)
                if total <= 1e-9:
                    total, begin, best, end = close(k + 1)
                elif total > best + 1e-9:
                    best, end = total, k
            close(0)
    out = []
    for a, b in spans:
        unit = pairs([w for _, ws in lines[a : b + 1] for w in ws])
        dice, _, name = max((2 * len(unit & pairs(w)) / (len(unit) + len(pairs(w))), -i, name) for i, (name, w) in enumerate(known))
        if dice >= least:
            out.append((lines[a][0], lines[b][0], name, dice))
    return sorted(out)


def notices():
    """Notices as they are pasted: in paragraphs, without a blank line around, in comment marks with code below, edited, twice."""
    import random
    import textwrap

    r = random.Random(5)
    mit, gpl, isc = (licences.TEMPLATES[i][1] for i in (2, 6, 13))
    a, b, c = re.split(r"(?<=conditions:) |(?<=Software\.) (?=THE)", mit)
    wrap = lambda t, n, mark="": "\n".join(mark + x for x in textwrap.wrap(t, n))
    prose = lambda n: "\n".join(" ".join(r.choice(["software", "the", "river", "without", "any", "old", "program", "and"]) for _ in range(9)) for _ in range(n))
    code = "int main() {\n  return program(1, 2);\n}\n" * 5
    texts = [
        f"{prose(20)}\n\nMIT License\n\nCopyright (c) 2020 A. Person\n\n{wrap(a, 75)}\n\n{wrap(b, 75)}\n\n{wrap(c, 75)}\n\n{prose(20)}",
        f"{prose(15)}\n{wrap(mit, 60)}\n{prose(15)}",
        f"#!/bin/sh\n{wrap(gpl, 70, '# ')}\n{code}",
        f"/*\n{wrap(isc, 70, ' * ')}\n */\n{code}{prose(3)}\n{wrap(isc, 50, '// ')}\n{code}",
        f"{prose(8)}\n{wrap(mit.replace('Software', 'Program', 4), 66)}\n{prose(8)}",
        f"{wrap(mit, 64)}\n{wrap(mit, 64)}\n{prose(4)}",
        f"{prose(30)}",
        wrap(" ".join(w for w in gpl.split() if r.random() < 0.5), 60),
        "\n \n\t\n",
    ]
    return [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(100, None, None, None, 0), (101, "", None, None, 0)]


def test_notices_over_runs_of_lines(spark, tmp_path):
    import duckdb

    df = documents(spark, notices())
    got = plain(licences.scan(df))
    runs = sorted((r[0], *r[1:3], r[3], r[4]) for r in got if r[2] is not None and r[2] > r[1])
    assert runs == sorted((d, *x) for d, t, *_ in notices() for x in plain_runs(t or "", 0.8))
    assert [(r[0], r[3]) for r in runs] == [(0, "MIT"), (1, "MIT"), (2, "GPL-3.0"), (3, "ISC"), (3, "ISC"), (3, "ISC"), (4, "MIT"), (5, "MIT"), (5, "MIT"), (5, "MIT")]  # of two near copies each, and both together
    df.write.parquet(f"{tmp_path}/documents")
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert sorted(connection.sql(licences.oracle()).fetchall(), key=str) == got


def test_licence_anchors_lose_nothing(spark, sf_dir):
    def pairs(s):
        w = re.sub("[^a-z0-9\n]+", " ", s.lower()).replace("\n", " ").split()
        return set(zip(w, w[1:], strict=False))

    want = []
    known = [(i, name, pairs(t)) for i, (name, t) in enumerate(licences.TEMPLATES)]
    for d, t in corpus(spark, sf_dir).select("doc_id", "text").collect():
        for n, unit in [*enumerate(t.split("\n")), *([(-1, t)] if "\n" in t else [])]:
            p = pairs(unit)
            best = max(((2 * len(p & b) / (len(p) + len(b)), -i, name) for i, name, b in known if p), default=(0, 0, ""))
            if best[0] >= 0.8:
                want.append((d, n, None if n < 0 else n, best[2], best[0]))
        want += [(d, *x) for x in plain_runs(t, 0.8)]
    assert plain(licences.scan(corpus(spark, sf_dir))) == sorted(want, key=str) and want


# ---- op3 and op4


def library(text):
    return tokens.tokenizer(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_packing(spark, docs, capacity):
    got = packing.pack(docs, capacity).collect()
    ids = defaultdict(list)
    for d, t, *_ in edge_documents():
        ids[d].append([*library(t), 0])
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        same = [x for x in ids[r.doc_id] if len(x) >= r.start + r.length and zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32]
        assert same and r.length <= capacity
        assert any(r.start == 0 if r.piece == 0 else (len(x) - r.start) % capacity == 0 for x in same)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.2 * sum(r.length for r in got) / capacity + 1


def test_packing_empty(empty):
    assert packing.pack(empty).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_best_two_fit(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(2048, r.lognormal(5.5, 1.3, 3000).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=2049)
    used, bins = np.zeros_like(histogram), 0
    for layout in packing.best_two_fit(histogram, 2048):
        assert sum(x * n for x, n, _ in layout.parts) <= 2048
        for x, n, first in layout.parts:
            assert first == used[x]
            used[x] += n * layout.bins
        bins += layout.bins
    assert (used == histogram).all() and bins <= -(-lengths.sum() // 2048) + 2


def test_token_counts(docs, empty):
    want = sorted(((d, len((t or "").encode()), n := len(library(t)), n > 20) for d, t, *_ in edge_documents()), key=str)
    got = plain(tokens.token_counts(docs, limit=20))
    assert [r[:4] for r in got] == want
    assert tokens.token_counts(empty).collect() == []


def test_cuts_hold_the_budget():
    counter = tokens.prefix_counter(tokens.default_vocabulary())
    for _, t, *_ in edge_documents():
        for budget in (0, 1, 7, 20):
            cut = counter.cut((t or "")[:3000], budget)
            assert len(library((t or "")[:cut])) <= budget


def test_every_prefix(spark):
    texts = ["don't  you're\n\n it'll", "x <|endoftext|> y", "aé日 本\t\t b", "   ", "", "tokenization of unbelievable words, 12345!"]
    got = tokens.prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert r.prefix_tokens == [len(library(texts[r.doc_id][:i])) for i in range(len(texts[r.doc_id]) + 1)]


def long_runs():
    return ["x" + " " * 1_000_000 + "y", "\n" * 1_000_000, "a" * 1_000_000, "ab" + "\t" * 5000 + " it's"]


def test_long_runs_are_counted_and_packed(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(long_runs())]
    want = {i: len(library(t)) for i, t, *_ in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark, rows)).collect()} == want
    sums = {}
    for r in packing.pack(documents(spark, rows)).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == {i: n + 1 for i, n in want.items()}


def test_cut_is_linear_in_english():
    import time

    counter = tokens.PrefixCounter(tokens.default_vocabulary())
    text = "it's the dog and cat,  don't you see?\n\nYes we're 12 " * 2400
    began = time.perf_counter()
    cut = counter.cut(text, 1024)
    assert time.perf_counter() - began < 1 and len(text) > 120_000
    assert len(library(text[:cut])) <= 1024 < len(library(text[: cut + 1]))
    assert counter.cut(text[:700], 90) == max(i for i in range(701) if len(library(text[:i])) <= 90)


def test_ids_equal_the_library(spark, sf_dir):
    encoder, counter = tokens.text_encoder(tokens.default_vocabulary()), tokens.prefix_counter(tokens.default_vocabulary())
    for (t,) in corpus(spark, sf_dir).select("text").collect():
        ids = library(t)
        assert encoder.packed(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert counter.total(t) == len(ids)


# ---- op5


def repeats(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    owner = {}
    for d, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if d is not None:
                owner[key] = min(owner.get(key, d), d)
    out = []
    for d, w in words:
        gone = {q for p in range(len(w) - window + 1) if d is not None and owner[tuple(w[p : p + window])] < d for q in range(p, p + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, k", [(50, 10), (12, 3), (5, 5)])
def test_repeats(docs, window, k):
    assert plain(substrings.repeat_digests(docs, window, k)) == repeats(edge_documents(), window)


def test_repeats_in_corpus(spark, sf_dir, empty):
    df = corpus(spark, sf_dir)
    assert plain(substrings.repeat_digests(df)) == repeats(df.select("doc_id", "text").collect(), 50)
    assert substrings.repeat_digests(empty).collect() == []


def thue_morse(flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))


def test_words_decide_not_their_hashes(spark):
    head = " ".join(f"w{i}" for i in range(49))
    rows = [(i, f"{head} {thue_morse(i)}", None, None, 0) for i in (0, 1)]
    rows += [(2 + i, head + " " + " ".join(thue_morse(i) * 2), None, None, 0) for i in (0, 1)]
    df = documents(spark, rows)
    assert plain(substrings.repeat_digests(df)) == repeats(rows, 50)
    assert {r.doc_id: r.n_removed for r in substrings.repeat_digests(df).collect() if r.doc_id < 2} == {0: 0, 1: 0}
    from tessera.llm import lines

    assert {r.n_removed for r in lines.drop_repeated_lines(df, report=True, similarity=1.0).collect()} == {0}


def test_paths_contract(spark):
    links = [(i, i + 1, 10) for i in range(40)] + [(100, 101, 3), (200, 201, 1), (201, 202, 2)]
    got = plain(substrings.contracted(spark.createDataFrame(links, "u long, v long, n int")))
    assert got == sorted([(i, 0, 10 * i) for i in range(1, 41)] + [(101, 100, 3), (201, 200, 1), (202, 200, 3)], key=str)


def test_repeated_paths(spark):
    import random

    r = random.Random(3)
    passages = [" ".join(f"p{r.randrange(500)}" for _ in range(r.choice((60, 90, 400)))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) for _ in range(r.randint(0, 3))] + [" ".join(f"q{r.randrange(900)}" for _ in range(30))]
        r.shuffle(parts)
        rows.append((i, "  ".join(parts + parts[:1] * (i % 7 == 0)), None, None, 0))
    rows += [(70, "x y " * 200, None, None, 0), (71, "x y " * 150, None, None, 0), (3, rows[5][1], None, None, 0)]
    assert plain(substrings.repeat_digests(documents(spark, rows))) == repeats(rows, 50)


# ---- op6


def test_quality(spark, sf_dir, docs, empty):
    df, labels = corpus(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(df, labels)
    got = quality.classify(df, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got} == {True}
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, model).collect())
    assert {r.score for r in quality.classify(docs, None).collect()} == {0.5}
    assert quality.train(docs, spark.createDataFrame([], labels.schema)) is None
    assert quality.classify(empty, model).collect() == []


def test_votes_of_neighbours():
    r = np.random.default_rng(4)
    counts = r.poisson(1.0, (40, 30)).astype(np.float32)
    vectors = r.normal(size=(25, 6)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    good, weight = (np.arange(25) % 2).astype(float), r.uniform(0.5, 2, 25)
    model = quality.Model(r.uniform(1, 2, 30).astype(np.float32), r.normal(size=(30, 6)).astype(np.float32), vectors, good, weight, 7)
    for row, got in zip(counts, model.score(counts), strict=True):
        z = (row * model.idf) @ model.axes
        cosine = [float(np.dot(z, v) / np.linalg.norm(z)) for v in vectors]
        near = sorted(range(25), key=lambda i: -cosine[i])[:7]
        say = [np.exp(12 * (cosine[i] - 1)) * weight[i] for i in near]
        assert abs(got - sum(x * good[i] for x, i in zip(say, near)) / sum(say)) < 1e-4


# ---- op9


def contamination(rows, items, window=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, found = low(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, few", [(1 << 24, 500_000), (1 << 13, 0)])
def test_contamination(spark, docs, empty, bits, few, monkeypatch):
    from tessera.llm import _tables

    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    monkeypatch.setattr(_tables, "BROADCAST_ROWS", few)
    rows = edge_documents()
    items = [(1, rows[0][1][300:500]), (10, "über STRASSE straße"), (2, "word word"), (3, ""), (4, None), (5, rows[3][1]), (None, "a"), (6, rows[0][1][300:500]), (7, "日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(rows, items)
    assert plain(decontaminate.contamination(docs, bench)) == want
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == sorted(str(r[0]) for r in want if not r[5])
    assert decontaminate.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_contamination_of_items_without_end(spark):
    items = [(i, " ".join(f"k{(i * 7 + j) % 4000}" for j in range(30))) for i in range(800)] + [(i, "the same ten words stand in every one of these items here") for i in range(900, 1100)]
    rows = [(1, items[5][1] + " x " + items[950][1], None, None, 0), (2, "nothing of it", None, None, 0)]
    df, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string").repartition(40)
    found = decontaminate.contamination(df, bench)
    assert plain(found) == contamination(rows, items)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") <= 2


def test_contamination_in_corpus(spark, sf_dir):
    df, bench = corpus(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert plain(decontaminate.contamination(df, bench)) == contamination(df.select("doc_id", "text").collect(), [tuple(r) for r in bench.select("item_id", "text").collect()])


# ---- op10


def test_language(spark, docs, empty):
    df = corpus(spark, "/root/testdata/sf0.01")
    model = langid.train_on(df)
    got = langid.identify(df.withColumn("held", langid.held_out()), model).collect()
    assert {r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got} == {True}
    assert np.mean([r.lang == r.lang_pred for r in got if r.held]) > 0.97
    found = {(r.doc_id, r.text): r for r in langid.identify(docs, model).collect()}
    assert [found[k].lang_pred for k in ((6, None), (7, ""), (8, " \n\t "), (9, "12345 !!! ###"))] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.train(empty) is None and langid.identify(empty, model).collect() == []
    alone = langid.train(documents(spark, [(1, "abc def", "xx", None, 7)]))
    assert {r.lang_pred for r in langid.identify(docs, alone).collect()} == {"xx", "und"}


def test_decoding_takes_the_nearest_codeword():
    r = np.random.default_rng(6)
    for classes in (2, 4, 9):
        code = langid.codewords(classes)
        model = langid.Model([f"l{i}" for i in range(classes)], code, np.zeros((1, code.shape[1]), np.float32), langid.MARGIN)
        bits = r.normal(size=(50, code.shape[1])) / 4
        best, score, close = model.decode(bits)
        for row, own, p, near in zip(bits, best, score, close, strict=True):
            loss = [sum(np.log1p(np.exp(-8 * b * c)) for b, c in zip(row, word, strict=True)) for word in code]
            order = sorted(range(classes), key=lambda i: loss[i])
            assert own == order[0] and abs(p - 1 / sum(np.exp(loss[own] - x) for x in loss)) < 1e-9
            assert near == (loss[order[1]] - loss[own] < langid.MARGIN * sum(code[own] != code[order[1]]))


def test_ambiguous_texts_are_flagged(spark):
    import random

    r = random.Random(2)
    df = corpus(spark, "/root/testdata/sf0.01")
    model = langid.train_on(df)
    noise = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(300)), None, None, 0) for i in range(60)]
    assert sum(x.ambiguous for x in langid.identify(documents(spark, noise), model).collect()) > 40
    lost = df.where("lang is not null").join(langid.determined(df, model).select("doc_id"), "doc_id", "left_anti").select("text").collect()
    assert all(not any(c.isalpha() for c in x.text or "") for x in lost)


@pytest.mark.parametrize("classes", [1, 2, 4, 5, 9, 40])
def test_codewords(classes):
    code = langid.codewords(classes)
    assert len(code) == classes and set(np.unique(code)) <= {-1.0, 1.0}
    assert len({tuple(row) for row in code}) == (classes if classes > 1 else 1)


def test_schema_of_helpers():
    assert SCHEMA.startswith("doc_id")


def test_long_lists_are_not_broadcast(spark, monkeypatch):
    from tessera.llm import _tables

    monkeypatch.setattr(_tables, "BROADCAST_ROWS", 100)
    lists = spark.range(10).selectExpr("id", "sequence(1, int(id) * 10) as spans", "cast(null as array<int>) as open")
    assert _tables.small_side(lists) is lists
    few = lists.where("id < 3")
    assert _tables.small_side(few) is not few
    assert _tables.small_side(lists.drop("spans", "open")) is not lists
    none = lists.where("id < 0")
    assert _tables.small_side(none) is not none


@pytest.mark.parametrize("few", [100, 0])
def test_rows_without_a_list_stay(spark, monkeypatch, few):
    from tessera.llm import _tables

    monkeypatch.setattr(_tables, "BROADCAST_ROWS", few)
    rows = spark.range(400).selectExpr("id % 200 as a", "nullif(id % 3, 2) as b", "id as __word")
    lists = spark.range(20).selectExpr("id * 10 as a", "id % 2 as b", "array(id) as spans")
    for how in ("left", "inner"):
        got = _tables.with_lists(rows, lists, ["a", "b"], how)
        assert plain(got.select("a", "b", "__word", "spans")) == plain(rows.join(lists, ["a", "b"], how).select("a", "b", "__word", "spans"))


def test_repeats_by_shuffled_lists(spark, monkeypatch, docs):
    from tessera.llm import _tables

    monkeypatch.setattr(_tables, "BROADCAST_ROWS", 0)
    assert plain(substrings.repeat_digests(docs, 12, 3)) == repeats(edge_documents(), 12)
