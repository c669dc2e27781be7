"""Language identification with error-correcting output codes (op10).

Each learned language has a codeword; for each bit a binary classifier over hashed byte n-grams tells languages with a one
from those with a zero. Decoding adds up each codeword's losses over all bits, weighted by how sure the bit's
classifier is, and takes the nearest; a small distance to the runner-up flags the text as ambiguous.

Training counts n-grams over every labelled row on the executors; the driver only sees one count per
language and n-gram bucket. Bits' weights are smoothed log odds of those counts.

Defined results: a text that is null or has no letter gets ``und`` with score 0 and is ambiguous; so does every text if nothing could be
learned; with a single learned language every text with a letter gets that one; of equally near languages the first in alphabetical order is taken. Very long
texts are read whole; repeated rows each get their result; an empty table gives an empty result. Other columns are kept; see ``identify`` on clashing names. The
driver gets ``BUCKETS`` counts for each language, so the number of languages, not of texts, bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from tessera.llm._tables import map_batches
from tessera.llm._words import slices

#: Hash buckets of n-grams.
BUCKETS = 1 << 13
GRAMS = (1, 2, 3)
UNDETERMINED = "und"
#: Loss by which the nearest codeword has to lead, for each bit of the code in which two languages differ; below, a text is ambiguous.
MARGIN = 1.5
#: Lower-case letters as they are, everything else in ASCII a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _gram_buckets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram that starts at each byte; ``BUCKETS`` where it would leave its row or is blank."""
    x = _FOLD[data].astype(np.uint32)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    places = np.arange(len(x))
    blank = x == 0x20
    for n in GRAMS:
        h = np.full(len(x), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        all_blank = np.ones(len(x), bool)
        for k in range(n):
            h[: len(x) - k] = (h[: len(x) - k] ^ x[k:]) * np.uint32(0x01000193)
            all_blank[: len(x) - k] &= blank[k:]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out = (h >> np.uint32(19)).astype(np.int32)
        out[all_blank | (places + n > ends)] = BUCKETS
        yield out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-grams of all texts by language, added up within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, bounds in slices(batch.column("text")):
                known = {lang: i for i, lang in enumerate(dict.fromkeys(langs[a:b]))}
                code = np.repeat(np.array([known[x] for x in langs[a:b]], np.int64), np.diff(bounds))
                total = np.zeros(len(known) * (BUCKETS + 1), np.int64)
                for h in _gram_buckets(data, bounds):
                    total += np.bincount(code * (BUCKETS + 1) + h, minlength=len(total))
                for lang, i in known.items():
                    own = total[i * (BUCKETS + 1) : (i + 1) * (BUCKETS + 1) - 1]
                    sums[lang] = sums[lang] + own if lang in sums else own
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    return rows.select("lang", "text").transform(map_batches, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per class: every split of up to five classes, else the best of many random codes."""
    if classes <= 5:
        half = range(1, 1 << max(0, classes - 1))
        return np.array([[1 if i == 0 or not split >> (i - 1) & 1 else -1 for split in half] for i in range(classes)], np.float64).reshape(classes, -1)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    tried = [rng.choice([-1.0, 1.0], (classes, length)) for _ in range(200)]
    tried = [m for m in tried if (np.abs(m.sum(0)) < classes).all()] or tried
    return max(tried, key=lambda m: ((length - (m @ m.T)) / 2 + np.eye(classes) * length).min())


@dataclass
class Model:
    """Learned languages, their codewords, and the bits' n-gram weights (buckets x bits; the last bucket weighs nothing)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    margin: float

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Mean log odds per n-gram of each row and bit."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        for a, b, data, bounds in slices(texts):
            filled = np.flatnonzero(np.diff(bounds))
            if not len(filled):
                continue
            total, seen = np.zeros((len(filled), out.shape[1])), np.zeros(len(filled))
            for h in _gram_buckets(data, bounds):
                for j in range(out.shape[1]):
                    total[:, j] += np.add.reduceat(self.weights[:, j].take(h), bounds[filled], dtype=np.float64)
                seen += np.add.reduceat(h < BUCKETS, bounds[filled], dtype=np.int64)
            out[a + filled] = total / np.maximum(seen, 1)[:, None]
        return out

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword of each row, its score, and whether the runner-up is about as near."""
        if len(self.languages) == 1:
            n = len(bits)
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        sure = 8 * bits
        loss = np.stack([(np.logaddexp(0, -sure * word)).sum(1) for word in self.code], 1)
        order = np.argsort(loss, 1, kind="stable")
        first, second = (np.take_along_axis(loss, order[:, i : i + 1], 1)[:, 0] for i in (0, 1))
        share = np.exp(first[:, None] - loss).sum(1)
        apart = (self.code[order[:, 0]] != self.code[order[:, 1]]).sum(1)
        return order[:, 0], 1 / share, second - first < self.margin * apart


def train(rows: DataFrame, margin: float = MARGIN) -> Model | None:
    """Model of the languages of ``rows`` (text, lang; a null in either is left out), or None if there are none."""
    found = gram_counts(rows.where("lang is not null and text is not null")).collect()  # one row per language and bucket at most
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return None
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for r in found:
        counts[at[r["lang"]], r["bucket"]] = r["n"]
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # each language counts alike in a bit's two sides
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        one, zero = shares[code[:, j] > 0].mean(0), shares[code[:, j] < 0].mean(0)
        weights[:-1, j] = np.log((one + 1e-6) / (zero + 1e-6))
    return Model(languages, code, weights, margin)


def _has_letter(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for a, _, data, bounds in slices(texts):
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            out[a + filled] = np.logical_or.reduceat(_LETTER[data], bounds[filled])
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return out


def _predicted(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, and whether it is ambiguous, of each text."""
    letters = _has_letter(texts) & (model is not None)
    lang, score, ambiguous = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts), bool)
    if model is not None:
        best, sure, close = model.decode(model.bits(texts))
        lang[letters] = np.array(model.languages, object)[best[letters]]
        score[letters], ambiguous[letters] = sure[letters], close[letters]
    return lang, score, ambiguous


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with the columns lang_pred, score and ambiguous, which take the place of columns of these names."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, ambiguous = _predicted(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], [*kept, "lang_pred", "score", "ambiguous"])

    schema = StructType([docs.schema[c] for c in kept]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    return docs.select(kept).transform(map_batches, predict, schema)


def determined(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language is determined and not ambiguous, with all their columns as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, ambiguous = _predicted(batch.column("text"), model)
            yield batch.filter(pa.array((lang != UNDETERMINED) & ~ambiguous))

    return docs.transform(map_batches, keep, docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether the CRC-32 of the id's decimal text leaves that remainder; never true of a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def train_on(docs: DataFrame) -> Model | None:
    """Model from the rows that are not held out."""
    return train(docs.where(~held_out()).select("text", "lang"))
