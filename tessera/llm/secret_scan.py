"""Secret scans (op11): patterns for the plain cases, and a character convolutional network over every other candidate with its surroundings.

Base findings are those of three patterns (assignments to names such as password or token, access keys, hexadecimal runs); they always stay. A candidate is
any longest run of at least ``SHORTEST`` letters, digits and ``+/_=-``. The network reads each
candidate with ``BEFORE`` bytes in front and ``BEHIND`` after it, in windows of ``WIDTH`` bytes that overlap by half, so that long ones are read to their end; the highest
window counts. It is a convolution over ``SPAN`` characters, maximum and mean over the window, and a logistic output, in numpy.

It is trained on labelled findings: (lead, stretch, positive), the stretch of bytes with its surroundings, where the candidate starts in it, and whether it is a secret. ``findings_of``
takes all of them from a corpus, candidates inside base findings as positive ones. In each round of ``train_on`` every task descends from the same weights over all its findings, and the means of
the tasks' weights begin the next. The surroundings of every second one are
blanked in training, so that a secret is also known by its own look. A quarter of them (by crc32 of the candidate) is held out: on it the score is
calibrated (Platt), and the threshold is the highest that finds ``recall`` of the held-out secrets. Candidates that reach it and do not touch a base finding are added as kind ``cnn``.

Defined results: null text is empty and has no findings; texts and candidates of any length are read whole; a row is a document, also if its id is null or repeats; fewer than
``LEAST`` findings of a label in a fold give no network, and then nothing is added; an empty table gives an empty one; other columns are ignored, whatever their names. The order of
findings is by start, then kind as listed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage, map_batches

#: Bytes, so that only ASCII letters have two cases; all that they match is ASCII, and a UTF-8 byte over 0x7F matches nothing.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # longest runs, so short ones need not be matched first
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "cnn")

SHORTEST = 12
BEFORE, BEHIND, WIDTH, SPAN = 24, 8, 96, 5
FILTERS, EPOCHS, RATE, BATCH = 24, 12, 4e-3, 128
LEAST = 8
#: Findings that are seen in training, about, counted again in each round; every round sees all of them.
SEEN, ROUNDS, LARGE_BATCH = 120_000, 3, 256

_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
#: What a byte is to the network: a letter of either case, a digit, one of some signs, another sign, a space, or beyond ASCII; 0 is nothing.
_SIGNS = b"\"'=:_-+/.,;|@#"
_CLASS = np.array([1 + (b | 32) - 97 if 97 <= (b | 32) <= 122 else 27 if 48 <= b <= 57 else 28 + _SIGNS.index(b) if b in _SIGNS else 42 if b > 0x7F else 43 if b <= 0x20 else 44 for b in range(256)])
_KINDS = 45
#: Inputs: one for each class, capital letter, hexadecimal digit, inside the candidate.
_INPUTS = _KINDS + 3


def base_findings(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base findings of a UTF-8 text, in bytes."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    small = raw.lower()
    if any(name in small for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    return sorted(found)


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _RUN[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    fit = end - start >= SHORTEST
    return list(zip(start[fit].tolist(), end[fit].tolist(), strict=True))


def _touching(spans: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> list[bool]:
    """Whether each run shares a byte with one of the spans (start, kind, end)."""
    if not spans:
        return [False] * len(runs)
    starts = np.array([s for s, _, _ in spans])
    reach = np.maximum.accumulate([e for _, _, e in spans])
    before = np.searchsorted(starts, [e for _, e in runs]) - 1  # the last span that starts before the run ends
    return [b >= 0 and reach[b] > s for b, (s, _) in zip(before.tolist(), runs, strict=True)]


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans in characters), and ``found``: each candidate's place, surroundings and whether a base finding has it."""
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lead", pa.int32()), ("size", pa.int32()), ("stretch", pa.binary()), ("base", pa.bool_())]))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, all_found, counts = [], [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                spans, runs = base_findings(raw), candidates(raw)
                at = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)) if (spans or runs) and not raw.isascii() else None
                place = (lambda i: i) if at is None else (lambda i, at=at: int(at[i]))
                all_found.append([
                    {"start": place(s), "end": place(e), "lead": min(s, BEFORE), "size": e - s, "stretch": raw[max(0, s - BEFORE) : e + BEHIND], "base": touched}
                    for (s, e), touched in zip(runs, _touching(spans, runs), strict=True)
                ])
                all_spans.append([{"start": place(s), "kind": kind, "end": place(e)} for s, kind, e in spans])
                counts.append([sum(kind == k for _, kind, _ in spans) for k in range(3)])
            n = zip(*counts, strict=True) if counts else ((), (), ())
            cells = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(all_spans, spans_type), pa.array(all_found, found)]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_assign", "n_access", "n_hex", "base", "found"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,lead:int,size:int,stretch:binary,base:boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_batches, scan, schema)


def findings_of(scans: DataFrame) -> DataFrame:
    """Every different labelled finding (lead, size, stretch, base) of what ``scanned`` found."""
    return scans.select(F.inline("found")).select("lead", "size", "stretch", "base").distinct()


def windows(lead: int, size: int, stretch: bytes, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (0 for nothing, and for blanked surroundings) and whether they are inside the candidate, of each window of WIDTH."""
    shift = BEFORE - lead
    n = 1 + max(0, -(-(shift + len(stretch) - WIDTH) // (WIDTH // 2)))
    data = np.zeros(WIDTH + (n - 1) * (WIDTH // 2), np.uint8)
    inside = np.zeros(len(data), bool)
    inside[BEFORE : BEFORE + size] = True
    data[shift : shift + len(stretch)] = np.frombuffer(stretch, np.uint8)
    if blank:
        data[~inside] = 0
    starts = np.arange(n) * (WIDTH // 2)
    at = starts[:, None] + np.arange(WIDTH)
    return data[at], inside[at]


#: Inputs of each byte, outside the candidate and inside.
_BITS = np.zeros((512, _INPUTS), np.float32)
for _b in range(1, 256):
    for _i in (0, 1):
        _BITS[_b + 256 * _i, [_CLASS[_b]]] = 1
        _BITS[_b + 256 * _i, _KINDS] = 0x41 <= _b <= 0x5A
        _BITS[_b + 256 * _i, _KINDS + 1] = _b in b"0123456789abcdefABCDEF"
        _BITS[_b + 256 * _i, _KINDS + 2] = _i


@dataclass
class Network:
    """Weights, the line that turns an output into a chance, and the least chance of a secret."""

    taps: np.ndarray  # SPAN x inputs x filters
    bias: np.ndarray
    out: np.ndarray  # 2 filters
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def pooled(self, codes: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reach = codes.shape[1] - SPAN + 1
        hidden = sum(tables[k][codes[:, k : k + reach]] for k in range(SPAN)) + self.bias
        np.maximum(hidden, 0, out=hidden)
        best = hidden.argmax(1)
        return hidden, best, np.concatenate([np.take_along_axis(hidden, best[:, None], 1)[:, 0], hidden.mean(1)], 1)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        tables = np.einsum("ci,kif->kcf", _BITS, self.taps)
        parts = [self.pooled(codes[i : i + 1024], tables)[2] @ self.out + self.offset for i in range(0, len(codes), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def chances(self, found: list[tuple[int, int, bytes]], blank: bool = False) -> np.ndarray:
        """Calibrated chance of each candidate (lead, size, stretch): that of its likeliest window."""
        return self.chance(self.best(found, blank))

    def chance(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(best * self.slope + self.shift, -50, 50)))

    def best(self, found: list[tuple[int, int, bytes]], blank: bool = False) -> np.ndarray:
        """The output of each candidate's likeliest window; windows are made and read a few MB at a time."""
        best = np.full(len(found), -np.inf, np.float64)
        held, owner, count = [], [], 0
        for i, (lead, size, stretch) in enumerate(found):
            data, inside = windows(lead, size, stretch, blank)
            for at in range(0, len(data), 4096):
                held.append(data[at : at + 4096] + 256 * inside[at : at + 4096].astype(np.int32))
                owner.append(np.full(len(held[-1]), i))
                count += len(held[-1])
                if count >= 4096:
                    np.maximum.at(best, np.concatenate(owner), self.raw(np.concatenate(held)))
                    held, owner, count = [], [], 0
        if held:
            np.maximum.at(best, np.concatenate(owner), self.raw(np.concatenate(held)))
        return best


def _started(random: np.random.Generator) -> Network:
    return Network(random.normal(0, 0.15, (SPAN, _INPUTS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), random.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)


def _fitted(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Network:
    """Gradient descent (Adam) on the weighted logistic loss, in a fixed order."""
    random = np.random.default_rng(11)
    net, descent = _started(random), Descent(random)
    for _ in range(EPOCHS):
        descent.go(net, codes, labels, weights)
    return net


class Descent:
    """Adam's moments over any number of passes."""

    def __init__(self, random: np.random.Generator, batch: int = BATCH):
        self.random, self.batch, self.moments, self.turn = random, batch, {}, 0

    def go(self, net: Network, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """One pass over the windows."""
        moments, reach = self.moments, codes.shape[1] - SPAN + 1
        order = self.random.permutation(len(codes))
        for at in range(0, len(order), self.batch):
            own = order[at : at + self.batch]
            self.turn += 1
            turn = self.turn
            x = _BITS[codes[own]]  # rows x WIDTH x inputs
            hidden, best, pooled = net.pooled(codes[own], np.einsum("ci,kif->kcf", _BITS, net.taps))
            chance = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.offset, -50, 50)))
            off = ((chance - labels[own]) * weights[own] / len(own)).astype(np.float32)
            back = off[:, None] * net.out
            spread = np.repeat(back[:, None, FILTERS:] / reach, reach, 1)
            np.put_along_axis(spread, best[:, None], np.take_along_axis(spread, best[:, None], 1) + back[:, None, :FILTERS], 1)
            spread *= hidden > 0
            flat = spread.reshape(-1, FILTERS)
            taps = np.stack([x[:, k : k + reach].reshape(-1, _INPUTS).T @ flat for k in range(SPAN)])
            steps = {"taps": taps + 1e-4 * net.taps, "bias": flat.sum(0), "out": pooled.T @ off + 1e-4 * net.out, "offset": off.sum()}
            for name, step in steps.items():
                a, b = moments.get(name, (0.0, 0.0))
                a, b = 0.9 * a + 0.1 * step, 0.999 * b + 0.001 * step * step
                moments[name] = a, b
                setattr(net, name, (getattr(net, name) - RATE * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)).astype(np.float32))


def train(findings: list[tuple[int, int, bytes, bool]], recall: float = 0.98) -> Network | None:
    """A calibrated network from labelled findings (lead, size, stretch, positive); None if a label has too few in either fold."""
    fold = np.array([zlib.crc32(stretch[lead : lead + size]) % 4 == 0 for lead, size, stretch, _ in findings], bool)
    label = np.array([positive for *_, positive in findings], bool)
    if any((own & (label == x)).sum() < LEAST for own in (fold, ~fold) for x in (True, False)):
        return None
    codes, labels, weights = [], [], []
    learned = [f for f, held in zip(findings, fold, strict=True) if not held]
    share = [sum(f[3] == x for f in learned) for x in (False, True)]
    for i, (lead, size, stretch, positive) in enumerate(learned):
        data, inside = windows(lead, size, stretch, blank=bool(i & 1))
        data, inside = data[:8], inside[:8]  # a long finding does not outweigh the others
        codes.append(data + 256 * inside.astype(np.int32))
        labels += [positive] * len(data)
        weights += [len(learned) / (2 * share[positive]) / len(data)] * len(data)
    net = _fitted(np.concatenate(codes), np.array(labels, np.float32), np.array(weights, np.float32))
    held = [f[:3] for f, own in zip(findings, fold, strict=True) if own]
    truth = label[fold]
    chance = np.clip(net.chances(held), 1e-9, 1 - 1e-9)
    net.slope, net.shift = _platt(np.log(chance / (1 - chance)), truth)
    found = np.sort(net.chances(held)[truth])
    net.threshold = float(found[int(np.floor(len(found) * (1 - recall)))])
    return net


def _mixed(learned: DataFrame, net: Network, number: int, share: dict[bool, int]) -> Network:
    """The mean of the weights to which the tasks descend from those of ``net``, each over all its findings."""
    total = sum(share.values())

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(net.taps.copy(), net.bias.copy(), net.out.copy(), net.offset)
        descent, seen = Descent(np.random.default_rng(11 + number), LARGE_BATCH if total > 20 * LARGE_BATCH else BATCH), 0
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("lead", "size", "stretch", "base", "times")), strict=True))
            for at in range(0, len(rows), 4096):
                codes, labels, weights = [], [], []
                for lead, size, stretch, positive, times in rows[at : at + 4096]:
                    data, inside = windows(lead, size, stretch)
                    codes.append(data + 256 * inside.astype(np.int32))
                    labels.append(np.full(len(data), positive, np.float32))
                    weights.append(np.full(len(data), times * total / (2 * share[positive]) / len(data), np.float32))
                    seen += times
                descent.go(own, np.concatenate(codes), np.concatenate(labels), np.concatenate(weights))
        if seen:
            flat = np.concatenate([own.taps.ravel(), own.bias, own.out, [own.offset]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["seen", "weights"])

    # a task gives one row of some 23 kB, whatever it has seen
    found = learned.transform(map_batches, fit, "seen long, weights binary").collect()
    mean = np.average([np.frombuffer(r["weights"], np.float32) for r in found], axis=0, weights=[r["seen"] for r in found]).astype(np.float32)
    a, b, c = np.cumsum([net.taps.size, net.bias.size, net.out.size])
    return Network(mean[:a].reshape(net.taps.shape), mean[a:b], mean[b:c], float(mean[c]))


def train_on(found: DataFrame, recall: float = 0.98) -> Network | None:
    """A calibrated network from all findings (lead, size, stretch, base); None if a label has too few in either fold. Findings stay in their tasks."""
    own = F.expr("substring(stretch, lead + 1, size)")
    held = F.crc32(own) % 4 == 0
    blank = ~held & (F.pmod(F.xxhash64("stretch", "lead", "size"), F.lit(2)) == 1)
    # what is blanked is the same for all findings of a candidate, which are learned from as one of that weight
    rows = found.select(held.alias("held"), "base", F.when(blank, 0).otherwise(F.col("lead")).alias("lead"), "size", F.when(blank, own).otherwise(F.col("stretch")).alias("stretch"))
    # in an order that does not hang on which shuffled block came first
    rows = cut_lineage(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")).sortWithinPartitions(F.xxhash64("stretch"), "stretch", "lead", "size", "base"))
    counts = {(r["held"], r["base"]): r["n"] for r in rows.groupBy("held", "base").agg(F.sum("times").alias("n")).collect()}
    if any(counts.get((h, x), 0) < LEAST for h in (True, False) for x in (True, False)):
        return None
    share = {x: counts[False, x] for x in (True, False)}
    net = _started(np.random.default_rng(11))
    for number in range(max(ROUNDS, min(EPOCHS, -(-SEEN // sum(share.values()))))):
        net = _mixed(rows.where("not held"), net, number, share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.best(list(zip(*(batch.column(c).to_pylist() for c in ("lead", "size", "stretch")), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column("base")], ["z", "base"])

    judged = cut_lineage(rows.where("held").transform(map_batches, judge, "z double, base boolean"))
    net.slope, net.shift = _platt_on(judged, counts[True, True], counts[True, False])
    least = judged.where("base").orderBy("z").offset(int(np.floor(counts[True, True] * (1 - recall)))).limit(1).first()["z"]
    net.threshold = float(net.chance(np.array([least]))[0])
    return net


def _platt_on(judged: DataFrame, positive: int, negative: int) -> tuple[float, float]:
    """As ``_platt``, over a table (z, base): each of Newton's steps sums over all of it."""
    target = F.when(F.col("base"), (positive + 1) / (positive + 2)).otherwise(1 / (negative + 2))
    x = F.greatest(F.least("z", F.lit(20.7)), F.lit(-20.7))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-(F.lit(a) * x + F.lit(b))))
        w = F.greatest(p * (1 - p), F.lit(1e-9))
        gx, g, wxx, wx, ww = judged.agg(F.sum((p - target) * x), F.sum(p - target), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        step = np.linalg.solve(np.array([[wxx + 1e-6, wx], [wx, ww + 1e-6]]), np.array([gx, g]))
        a, b = max(1e-3, a - float(np.clip(step[0], -0.5, 0.5))), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def _platt(x: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic line through held-out outputs, with Platt's softened targets (Newton's steps, the slope kept above 0)."""
    n = truth.sum(), (~truth).sum()
    target = np.where(truth, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        off, w = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(off * x).sum(), off.sum()])
        curve = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(curve, grad)
        a, b = max(1e-3, a - float(np.clip(step[0], -0.5, 0.5))), b - float(np.clip(step[1], -2, 2))
    return a, b


def secrets(docs: DataFrame, recall: float = 0.98, network: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; the network is trained on the base findings if none is given."""
    scans = cut_lineage(scanned(docs))
    if network is None:
        network = train_on(findings_of(scans), recall)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[(s["start"], s["kind"], s["end"]) for s in spans] for spans in batch.column("base").to_pylist()]
            extra: list[list[tuple[int, int, int]]] = [[] for _ in base]
            if network is not None:
                open_ones = [(i, f) for i, found in enumerate(batch.column("found").to_pylist()) for f in found if not f["base"]]
                chances = network.chances([(f["lead"], f["size"], f["stretch"]) for _, f in open_ones])
                for (i, f), chance in zip(open_ones, chances.tolist(), strict=True):
                    if chance >= network.threshold:
                        extra[i].append((f["start"], 3, f["end"]))
            digests = [hashlib.sha256(_named(spans).encode()).hexdigest() for spans in base]
            spans = [_named(sorted(b + e)) for b, e in zip(base, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scans.transform(map_batches, add, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
