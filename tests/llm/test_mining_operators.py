"""Secret scans, collocations and the divergence audit against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import documents, edge_documents, plain
from tessera.llm import collocations, divergence, secret_scan


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, clash=True)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, rows=[])


def in_duckdb(df, sql, path):
    df.write.parquet(f"{path}/documents")
    with duckdb.connect() as connection:
        connection.sql(f"create view documents as select * from '{path}/documents/*.parquet'")
        found = connection.sql(sql)
        return found.columns, sorted(found.fetchall(), key=str)


# ---- op11

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    """(start, kind, end) by the patterns as they are stated."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_base_findings_are_those_of_the_patterns(spark):
    r = random.Random(3)
    parts = ["password", "PassWD", "secret", "token=", "api_key", "APIKEY", "apikey: ", '"', "'", " = ", ":", "=", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 4, "0123abcd" * 5, "é", "ſecret", "toKen", "日本", " ", "\n", "abcDEF12", "x" * 9, "-._/+", "ß"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(800)] + [None, "", "password = \"" + "a1" * 60_000 + "\" é"]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = secret_scan.secrets(documents(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    for row in got:
        want = plain_base(texts[row.doc_id] or "")
        named = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert row.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [x for x in row.spans.split(",") if x and not x.startswith("cnn")] == named


def test_secrets_edges(docs, empty):
    assert secret_scan.secrets(empty).collect() == []
    got = secret_scan.secrets(docs).collect()  # no finding to learn from: nothing is added
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_documents())
    assert {(r.n_assign, r.n_access, r.n_hex, r.spans) for r in got} == {(0, 0, 0, "")}


def labelled(n, seed):
    """Findings with and without a telling name, and candidates that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "re", "on", "li", "se", "mo", "ti", "an"]) for _ in range(r.randrange(2, 10)))
    out = []
    for i in range(n):
        if i % 2:
            own, before = "".join(r.choice("0123456789abcdef") for _ in range(40)), r.choice(["token = ", "key is ", "secret: "])
            own = own.upper() if i % 3 else own
        else:
            own, before = r.choice([lambda: word() + "-" + word() + "-" + word(), lambda: str(r.randrange(10**14, 10**15)), lambda: word() * 3])(), word() + " "
        raw, start = f"{word()} {before}{own} {word()}".encode(), len(word()) * 0
        start = raw.index(own.encode())
        out.append((min(start, secret_scan.BEFORE), len(own), raw[max(0, start - secret_scan.BEFORE) : start + len(own) + secret_scan.BEHIND], bool(i % 2)))
    return out


def test_network_on_held_out_findings():
    net = secret_scan.train(labelled(800, 1), recall=0.98)
    found = labelled(400, 2)
    truth, chances = np.array([f[3] for f in found]), net.chances([f[:3] for f in found])
    assert (chances[truth] >= net.threshold).mean() >= 0.95 and (chances[~truth] >= net.threshold).mean() <= 0.05
    assert abs(chances.mean() - truth.mean()) < 0.05  # calibrated
    # a secret at the end of a very long candidate is read
    long = b"ta-re-on-li-se" * 400
    buried = long + b"0f3b9c1e7a5d2468" * 6
    assert net.chances([(0, len(buried), buried)])[0] >= net.threshold > net.chances([(0, len(long), long)])[0]
    assert secret_scan.train(labelled(20, 1)) is None


def test_network_adds_to_the_patterns(spark):
    r = random.Random(4)
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    long = lambda: "".join(r.choice(["ta", "re", "on", "li", "se", "mo", "ti", "an"]) for _ in range(r.randrange(7, 15)))
    rows = [(i, f"some {long()} words here token = {code()} and {long()} {long()} follow {i}", "en", "a", 0) for i in range(120)]
    network = secret_scan.train(labelled(800, 1))
    rows += [(200 + i, f"straße café the digest {code().upper()} stands without a name", "en", "a", 0) for i in range(20)]
    got = {x.doc_id: x.spans for x in secret_scan.secrets(documents(spark, rows), network=network).collect()}
    assert all("cnn" not in got[i] for i in range(120))
    assert sum(got[200 + i] == "cnn:23:63" for i in range(20)) >= 18


def test_touching_spans():
    spans = [(0, 0, 10), (2, 2, 4), (20, 1, 25)]
    assert secret_scan._touching(spans, [(0, 1), (9, 12), (10, 12), (19, 21), (25, 30), (15, 40)]) == [True, True, False, True, False, True]


# ---- op12


def plain_collocations(rows, least, inside, top):
    grams, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    grams[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in grams.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + n] for g, a in found.items() for n in range(2, len(g)) for i in range(len(g) - n + 1) if 100 * a >= inside * f[g[i : i + n]]}
        best = []
        for g, a in found.items():
            if g not in gone:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                best.append((score, a, " ".join(g), left, right))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, words[lang], s) for i, (s, a, p, left, right) in enumerate(best[:top], 1)]
    return sorted(out, key=str)


def phrases(n, seed=7):
    r = random.Random(seed)
    words = ["new", "york", "times", "ÉTÉ", "日本", "a", "b", "c\x1cd", "z" * 40]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\x0b", "! "]) for _ in range(r.randrange(60)))
        rows.append((i, text + r.choice(["", "New York Times", "a a a a"]), r.choice(["en", "en", "de", None, ""]), "s", 0))
    return rows + [(n, None, "en", "s", 0), (n, "one two three " * 400, "en", "s", 0), rows[0], rows[0]]


@pytest.mark.parametrize("least,inside,top", [(30, 80, 2000), (3, 60, 40)])
def test_collocations(spark, tmp_path, least, inside, top):
    rows = edge_documents() + phrases(300)
    df = documents(spark, rows, clash=True)
    got = collocations.collocations(df, least, inside, top)
    want = plain_collocations(rows, least, inside, top)
    assert plain(got) == want and want
    assert in_duckdb(df, collocations.oracle(least, inside, top), tmp_path) == (got.columns, want)


def test_collocations_edges(empty, spark):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None, None, 0), (2, " ", "en", "a", 0)])).collect() == []


def test_large_sums_stay_exact(spark):
    big = 3 * 10**18
    row = [("en", "x y", big, 2)], "lang string, phrase string, a long, words int"
    counts = spark.createDataFrame([("en", "x", big + 7), ("en", "y", big)], "lang string, phrase string, f long")
    [got] = collocations._scored(spark.createDataFrame(*row), counts).collect()
    assert (got.l, got.r, got.score) == (big + 7, big, 2_000_000 * big // (2 * big + 7))


# ---- op13


def plain_audit(rows, least, k):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: counts[x, s] for x, s in counts if x == lang}

        def chances(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = chances(sum(own.values(), Counter()))
        for s, n in own.items():
            p = chances(n)
            far = [(sum(f(p[t], o[t]) for t in kept), x) for x in own if x != s for o in [chances(own[x])]]
            terms = [(f(p[t], q[t]), t) for t in kept if n[t] and p[t] > q[t]]
            for part, values, most in (("pair", far, None), ("term", terms, k)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, x, v, i) for i, (v, x) in enumerate(values[:most], 1)]
    return sorted(out, key=str)


def sources(n, many, seed=9):
    r = random.Random(seed)
    words = [w + x for w in ("the", "of", "été", "日本", "Straße", "x") for x in ("", "a", "b", "é", "cc")]
    rows = []
    for i in range(n):
        s = r.randrange(many)
        own = words[s % 7 :: 1 + s % 3]
        rows.append((i, " ".join(r.choice(own) for _ in range(r.randrange(60))).upper() + "1_x", r.choice(["en", "de", None]), f"s{s}" if s else None, 0))
    return rows + [(n, None, "en", "empty", 0), (n + 1, "123 !", "fr", "p", 0), (n + 1, "", "fr", "q", 0), rows[0], rows[0], (n + 2, "lone " * 40_000, "en", "long", 0)]


@pytest.mark.parametrize("many,block,least", [(6, 128, 10), (40, 8, 2)])
def test_divergence(spark, tmp_path, many, block, least):
    rows = edge_documents() + sources(250, many)
    df = documents(spark, rows, clash=True)
    got = divergence.audit(df, least, 5, block)
    want = plain_audit(rows, least, 5)
    assert plain(got) == want and {x[2] for x in want} == {"pair", "term"}
    assert in_duckdb(df, divergence.oracle(least, 5), tmp_path) == (got.columns, want)


def test_divergence_edges(empty):
    assert divergence.audit(empty).collect() == []


def test_search_goes_on_until_bounds_are_below_the_last_value(spark):
    """Terms of one count and one chance tie: the search must not stop at an equal bound."""
    rows = [(i, " ".join(f"w{chr(97 + j)}" * (1 + (j + i) % 3 // 2) for j in range(26)) + " odd" * (i % 2), "en", f"s{i % 2}", 0) for i in range(40)]
    kept = divergence._kept_terms(documents(spark, rows), 1)
    groups = divergence._groups(documents(spark, rows), kept)
    got = sorted(tuple(r) for r in divergence._standing_out(kept, groups, 10, first_round=1).drop("rank").collect())
    want = sorted((lang, s, item, v) for lang, s, part, item, v, _ in plain_audit(rows, 1, 10) if part == "term")
    assert got == want


def test_network_learns_from_all_findings(spark):
    rows = [(i, f"candidate-of-number-{i} and another-one-of-{i}", "en", "a", 0) for i in range(2000)]
    found = secret_scan.findings_of(secret_scan.scanned(documents(spark, rows)))
    assert found.count() == 4000  # no cut by number
    learned = [(lead, size, stretch, positive) for lead, size, stretch, positive in labelled(4000, 1)]
    net = secret_scan.train_on(spark.createDataFrame(learned, "lead int, size int, stretch binary, base boolean").repartition(3))
    found = labelled(400, 2)
    truth, chances = np.array([f[3] for f in found]), net.chances([f[:3] for f in found])
    assert (chances[truth] >= net.threshold).mean() >= 0.95 and (chances[~truth] >= net.threshold).mean() <= 0.05
    few = spark.createDataFrame(labelled(20, 1), "lead int, size int, stretch binary, base boolean")
    assert secret_scan.train_on(few) is None
