"""Approximate nearest neighbours: inverted file with product-quantised residuals and exact reranking (op2).

Equal vectors are one entry, with the few smallest ids that a result can show. A bounded sample trains coarse centroids and
codebooks for the residuals, and tells how many lists have to be read for the wanted recall (the data decide: clustered
vectors need few, vectors without structure many). Every entry is then coded into its list. Lists of any
length are dealt into blocks, queries of a list likewise; blocks meet in a join on the list, and asymmetric
distance tables (query against codebook) rank a block's codes. The best candidates of each query are scored again
on the original vectors in double precision.

Nearness is the inner product. Defined results: vectors that are null, zero, or that hold a null or a
number that is not finite take no part, nor do rows without an id; vectors of different lengths are searched apart; a query with fewer candidates than ``k`` gets all
of them; ties go to the smaller id; a repeated id counts once per row, and each of its rows asks and is found by the others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage, map_batches

#: Entries of a list, and queries, that one task compares at a time.
BLOCK, QUERIES = 4096, 256
#: Dimensions per codebook, and entries in each.
STEP, CODES = 2, 256
#: Most lists, and vectors of the sample for each. Lists grow with the square root of the entries up to there, and the sample with them.
LISTS, PER_LIST = 16_384, 16


@dataclass
class Index:
    """Coarse centroids, each list's residual scale, residual codebooks (parts x codes x STEP), and lists that a query reads.

    Residuals are coded in units of their list's scale, so that a dense list is told apart as finely as a wide one.
    """

    centroids: np.ndarray
    scales: np.ndarray
    books: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def padded(self, x: np.ndarray) -> np.ndarray:
        width = self.books.shape[0] * STEP
        return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = self.padded((x - self.centroids[own]) / self.scales[own, None]).reshape(len(x), -1, STEP)
        return np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """parts x queries x codes: inner product of each part of a query with each code."""
        return np.einsum("qmd,mcd->mqc", self.padded(queries).reshape(len(queries), -1, STEP), self.books, optimize=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums, n = np.zeros_like(centres, np.float64), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def lists_for(entries: int) -> int:
    return int(np.clip(np.sqrt(entries) / 2, 1, LISTS))


def fit(sample: np.ndarray, entries: int, k: int, recall: float, seed: int = 11) -> Index:
    """Index from a sample of the distinct vectors; ``entries`` is how many there are in all."""
    rng = np.random.default_rng(seed)
    lists = min(lists_for(entries), max(1, len(sample) // 8))
    centroids = _kmeans(sample, lists, 12, rng)
    own = _nearest(sample, centroids)
    parts = -(-sample.shape[1] // STEP)
    rest = sample - centroids[own]
    scales = np.sqrt(np.bincount(own, (rest.astype(np.float64) ** 2).sum(1), lists) / np.maximum(np.bincount(own, minlength=lists), 1)).astype(np.float32)
    scales[scales < 1e-6] = 1
    rest = np.pad(rest / scales[own, None], ((0, 0), (0, parts * STEP - sample.shape[1])))[rng.permutation(len(sample))[:6000]]
    books = np.stack([_kmeans(rest[:, m * STEP : (m + 1) * STEP], min(CODES, len(rest)), 8, rng) for m in range(parts)])
    # lists to read: what the sample itself needs
    asked = np.arange(0, len(sample), max(1, len(sample) // 400))
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return Index(centroids, scales, books, lists)
    true = own[np.argpartition(-near, k - 1, axis=1)[:, :k]]
    place = np.argsort(np.argsort(-(sample[asked] @ centroids.T), 1, kind="stable"), 1)
    needed = np.sort(np.take_along_axis(place, true, 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Index(centroids, scales, books, min(lists, probes + 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("v")).where("vec_id is not null and v is not null")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal everywhere
    return fine.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 20_000, recall: float = 0.98, per_block: int = 100, rerank: int = 250) -> DataFrame:
    """The ``k`` nearest found of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    An index is fitted on up to ``sample`` vectors, or ``PER_LIST`` for each list if that is more. A query takes ``per_block`` candidates from each block of up to
    ``BLOCK`` codes that it reads, and scores the ``rerank`` best of them exactly; both bound the search, and recall is measured with them.
    """
    rows = cut_lineage(valid_vectors(vectors))
    sizes = sorted(r["_size"] for r in rows.select(F.size("v").alias("_size")).distinct().collect())  # lengths of vectors, not vectors
    parts = [_search(rows.where(F.size("v") == size), every, k, sample, recall, per_block, rerank) for size in sizes]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, every: int, k: int, sample: int, recall: float, per_block: int, rerank: int) -> DataFrame:
    """``search`` among vectors of one length."""
    shown = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    entries = cut_lineage(shown.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()))
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = cut_lineage(queries.join(entries, "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")))
    n = entries.count()
    share = min(1.0, max(sample, PER_LIST * lists_for(n)) / max(n, 1))
    taken = entries.where(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < share * 1_000_003).orderBy("ids", "v").select("v").toPandas()["v"]
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(taken):
        taken = entries.orderBy("ids", "v").limit(1000).select("v").toPandas()["v"]  # by chance no entry of a tiny table was taken
    if not len(taken):
        return empty
    index = fit(np.stack(taken.to_list()).astype(np.float32), n, k, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            own = index.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in index.encode(x, own)], pa.binary())], ["cid", "list", "code"])

    coded = cut_lineage(entries.select("cid", "v").transform(map_batches, code, "cid long, list int, code binary"))
    sizes = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # a row per list
    counts = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            order = np.argsort(-(x @ index.centroids.T), 1, kind="stable")
            met = np.cumsum(counts[order], 1)
            # at least the fitted number of lists, and enough of them to fill a result
            read = np.maximum(index.probes, (met < 4 * k).sum(1) + 1)
            take = np.minimum(read, len(counts))
            at = np.repeat(np.arange(len(x)), take)
            which = np.concatenate([order[i, :t] for i, t in enumerate(take)]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at)), pa.array(which.astype(np.int32)), batch.column("v").take(pa.array(at))], ["qid", "list", "v"])

    centre = F.broadcast(rows.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(counts)], "list int, _n long"))  # a row per list
    deal = lambda key, size: F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / size)).cast("int")
    blocks = coded.join(centre, "list").withColumn("_b", deal("cid", BLOCK)).groupBy("list", "_b").agg(F.sort_array(F.collect_list(F.struct("cid", "code"))).alias("rows"))
    wanted = asked.select("qid").distinct().join(entries, F.col("qid") == F.col("cid")).select("qid", "v").transform(map_batches, probe, "qid long, list int, v array<float>")
    asks = wanted.groupBy("list", F.pmod(F.xxhash64("qid"), F.lit(max(1, n // (every * QUERIES)) + 1)).alias("_q")).agg(F.collect_list(F.struct("qid", "v")).alias("asks"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asks, held = batch.column("asks")[i].values, batch.column("rows")[i].values
                qid, x = np.asarray(asks.field("qid")), _matrix(asks.field("v"))
                cid = np.asarray(held.field("cid"))
                codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(cid), -1)
                for at in range(0, len(qid), QUERIES):
                    q = x[at : at + QUERIES]
                    own = batch.column("list")[i].as_py()
                    score = np.zeros((len(q), len(cid)), np.float32)
                    for m, t in enumerate(index.tables(q)):
                        score += t[:, codes[:, m]]
                    score = score * index.scales[own] + (q @ index.centroids[own])[:, None]
                    take = min(per_block, len(cid))
                    best = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[at : at + QUERIES], take)), pa.array(cid[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel().astype(np.float64))], ["qid", "cid", "near"])

    found = asks.join(blocks, "list").select("list", "asks", "rows").transform(map_batches, rank, "qid long, cid long, near double")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "cid"))).where(F.col("_r") <= rerank).select("qid", "cid")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = best.join(entries, "cid").join(entries.select(F.col("cid").alias("qid"), F.col("v").alias("q")), "qid").select("qid", "cid", "ids", product.alias("score"))
    top = scored.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("_r") <= k + 1)
    members = top.select("qid", "cid", "score", F.explode("ids").alias("vec_id"))
    members = members.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    lists = members.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score", (F.col("cid") == F.col("qid")).alias("_same")))).alias("_found"))
    # the query's own row is one of those with its id and its vector; others that share only the id are candidates
    own = "array_position(transform(_found, x -> x._same and x.vec_id = query_id), true)"
    mine = asked.join(lists, "qid").select("query_id", F.expr(f"slice(filter(_found, (x, i) -> i + 1 <> {own}), 1, {k})").alias("_found"))
    return mine.select("query_id", F.posexplode("_found").alias("_at", "_hit")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))
