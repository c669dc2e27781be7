"""Quality classification by nearest neighbours among labelled latent-semantic vectors (op6).

Terms are hashed byte trigrams and a few coarse traits of a text's style (share of capitals and of marks, variety of
words, length), weighted by logarithmic frequency and inverse document frequency. A truncated singular value
decomposition of a bounded labelled sample gives latent axes. The sample's vectors and the axes are broadcast,
both of a size fixed by parameters; every text is projected and compared with every labelled vector in blocks of
exact cosine products, and its nearest neighbours vote with weights that grow with similarity.

The two classes are weighted to even sides, so a rare class is heard. Defined results: null and empty texts have the same,
word-free trait vector and are scored like any other; without a label all scores are 0.5; rows of ``labels`` with a null are
left out; a document that has several labels is learned once, at their mean rounded up; of neighbours that are equally near any may vote; very long texts are
read whole; repeated rows each get their score; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import map_batches
from tessera.llm._words import NOT_SPACE, slices, split

TERMS = 2048
TRAITS = 4 * 8
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_MARK = np.zeros(256, bool)
for _lo, _hi in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _MARK[_lo : _hi + 1] = True


def term_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x (terms and traits) of one slice of texts."""
    rows, sizes = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((rows, TERMS + TRAITS), np.float32)
    x = data.astype(np.uint32)
    row = np.repeat(np.arange(rows), sizes)
    if len(x) >= 3:
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        inside = row[:-2] == row[2:]
        key = row[:-2] * TERMS + (h >> np.uint32(21)).astype(np.int64)
        out[:, :TERMS] = np.log1p(np.bincount(key[inside], minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32))
    words = split(data, bounds, NOT_SPACE)
    n = np.diff(words.first)
    order = np.lexsort((words.hash, words.row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])
    kinds = np.bincount(words.row[order][fresh], minlength=rows)
    some = np.maximum(sizes, 1)
    shares = (
        np.bincount(row, _CAPITAL[data], rows) / some * 8,
        np.bincount(row, _MARK[data], rows) / some * 24,
        kinds / np.maximum(n, 1) ** 0.9 * 6,
        np.log2(1 + n) / 2,
    )
    for k, share in enumerate(shares):
        out[np.arange(rows), TERMS + 8 * k + np.clip(share, 0, 7).astype(np.int64)] = 6
    return out


@dataclass
class Model:
    """Weights of terms, latent axes, labelled vectors on them (unit length) and each one's say for its label."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    weight: np.ndarray
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = (counts * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.empty(len(counts))
        for at in range(0, len(counts), 256):
            cosine = self.project(counts[at : at + 256]) @ self.vectors.T
            k = min(self.neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            say = np.exp(12 * (np.take_along_axis(cosine, near, 1) - 1)) * self.weight[near]
            out[at : at + 256] = (say * self.good[near]).sum(1) / np.maximum(say.sum(1), 1e-300)
        return out


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """About ``size`` labelled rows of each class (all, if fewer), by hash of the id; (doc_id, quality, text)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    share = F.lit(0.0)
    for quality, n in counts.items():
        share = F.when(F.col("quality") == quality, min(1.0, size / n)).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")  # 2 * size rows, about


def train(docs: DataFrame, labels: DataFrame, size: int = 1500, axes: int = 64, neighbours: int = 15) -> Model | None:
    """Model from about ``size`` labelled documents of each class; None without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in slices(batch.column("text")):
                rows = [x.astype(np.float16).tobytes() for x in term_counts(data, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array(rows, pa.binary())], ["doc_id", "quality", "terms"])

    found = _sample(docs, labels, size).select("doc_id", "quality", "text").transform(map_batches, count, "doc_id long, quality int, terms binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["doc_id"], r["terms"]))
    counts = np.stack([np.frombuffer(r["terms"], np.float16).astype(np.float32) for r in found])
    good = np.array([r["quality"] for r in found], np.float64)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    weighted = counts * idf
    values, vectors = np.linalg.eigh(weighted.T @ weighted)
    axis = vectors[:, np.argsort(-values)[: min(axes, len(counts))]].astype(np.float32)
    side = np.where(good > 0, (good > 0).sum(), (good <= 0).sum())
    model = Model(idf, axis, np.zeros((0, 0), np.float32), good, (len(good) / side / 2).astype(np.float64), neighbours)
    model.vectors = model.project(counts)
    return model


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), 0.5)
            if model is not None:
                for a, b, data, bounds in slices(batch.column("text")):
                    out[a:b] = model.score(term_counts(data, bounds))
            out = np.clip(out, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").transform(map_batches, score, "doc_id long, held_out boolean, score double, predicted int")
