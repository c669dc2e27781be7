"""Phrase collocation mining (op12): phrases of two to four words that stand together more often than their parts would.

Texts are cut into pieces at punctuation, and equal pieces of a language are one piece with a multiplicity. N-grams of pieces, weighted by it, are
added up in tasks and then, in the bucket of their hash, in DuckDB, which goes to disk when a bucket does not fit its memory. First only hashes are counted, of words, then of
pairs of words that may be frequent, then of three and four words: a phrase that occurs ``least`` times has parts that do, and a hash at least the occurrences of its phrase, so
what these counts rule out is not frequent. The phrases that are left are counted as texts. Each candidate then asks for the counts of its parts:
requests are shuffled to where those counts are, and the answers back to the candidate.

Arithmetic is exact: products are decimals. A candidate cut after its first k words scores floor(2,000,000 a / (l + r)), the lowest cut counts; a candidate that stands inside a
longer one of at least ``inside`` percent of its count is dropped. Of each language the first ``top`` are returned.

Defined results: null text is empty and null lang is 'und'; rows count as often as they are there; texts and pieces are taken whole
at any length; ties go by count, then by the phrase's UTF-8 bytes; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm._tables import cut_lineage, map_batches, small_side
from tessera.llm._words import Words, grams, slices, split

#: Bytes that end a piece become line feeds, other spaces become spaces, letters become small.
_PIECE = bytes(0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = np.ones(256, bool)
_WORD[0x20] = False
#: Bytes of different pieces, n-grams, and hashes of n-grams, that a task adds up together before it hands them on.
HELD_BYTES, HELD_GRAMS, HELD_HASHES = 48 << 20, 1_000_000, 4_000_000
#: Memory of DuckDB in a task; beyond it a bucket's sums go to a scratch folder that the task deletes.
MEMORY = "384MB"
#: Bits of a sieve for each frequent phrase, and at most.
SIEVE_BITS, MOST_BITS = 16, 1 << 31
#: Parts in which a language's candidates are ranked first.
RANKED = 64


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): different pieces, their words set apart by one space, and how often they occur."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], int] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for raw in text.encode().translate(_PIECE).split(b"\n"):
                    if words := raw.split():
                        key = (lang, b" ".join(words))
                        before = found.get(key, 0)
                        found[key] = before + 1
                        held += 0 if before else len(raw) + 100
                if held > HELD_BYTES:
                    yield handed_on(found)
                    found, held = {}, 0
        yield handed_on(found)

    def handed_on(found: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        langs, texts = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "piece", "times"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.transform(map_batches, scan, "lang string, piece string, times long").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def _hashes(words: Words, seeds: np.ndarray, n: int) -> np.ndarray:
    """Of the n words from each word on, with their language; 0 where fewer are left."""
    return grams(words.hash ^ seeds[words.row], words.row, n)


def _seeds(langs: list[str]) -> np.ndarray:
    known = {x: xxh3_64_intdigest(x) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _passes(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(sieve) - 1)
    return (hashes > 0) & ((sieve[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _fitting(words: Words, seeds: np.ndarray, n: int, parts) -> np.ndarray:
    """Where an n-gram starts whose every part, that the sieve ``parts`` (words of a part, bits) knows, passes it."""
    count = len(words.start) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    fit = words.row[:count] == words.row[n - 1 :]
    if parts:
        known = _passes(_hashes(words, seeds, parts[0]), parts[1])
        for k in range(n - parts[0] + 1):
            fit &= known[k : k + count]
    return np.flatnonzero(fit)


def _in_duckdb(batches: Iterator[pa.RecordBatch], schema: pa.Schema, sql: str) -> Iterator[pa.RecordBatch]:
    """What ``sql`` makes of the table ``parts`` of a bucket's rows, which DuckDB reads as they come and keeps on disk beyond its memory."""
    import duckdb

    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as bucket:
        bucket.register("parts", pa.RecordBatchReader.from_batches(schema, batches))
        yield from bucket.sql(sql).to_arrow_reader(50_000)


def likely(found: DataFrame, sizes: tuple[int, ...], least: int, parts=None):
    """Bits, broadcast, that the hash of every n-gram of ``sizes`` with ``least`` occurrences has; at most 256 MB.

    Only hashes are shuffled, a run of them a row: 32 bits and, of the others, the bucket. Hashes that fall together have their occurrences added, so no frequent n-gram is lost.
    """
    spark = found.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task packs a row for each partition, not more
    kind = np.uint8 if least < 256 else np.int64  # more occurrences than ``least`` say no more

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            seeds, times = _seeds(batch.column("lang").to_pylist()), batch.column("times").to_numpy()
            for first, last, data, bounds in slices(batch.column("piece")):
                words = split(data, bounds, _WORD)
                own = seeds[first:last]
                for n in sizes:
                    at = _fitting(words, own, n, parts and (parts[0], parts[1].value))
                    h = _hashes(words, own, n)[at]
                    held.append((((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)), np.minimum(times[first + words.row[at]], least)))
                    rows += len(at)
                if rows > HELD_HASHES:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, times = key[start], np.minimum(np.add.reduceat(times, start), least).astype(kind)
        bucket = (key >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        runs = list(zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True))
        low = key.astype(np.uint32)
        cells = [[x[s:e].tobytes() for s, e in runs] for x in (low, times)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *(pa.array(c, pa.binary()) for c in cells)], ["bucket", "low", "times"])

    unpacked = pa.schema([("key", pa.int64()), ("times", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, low, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "times")), strict=True):
                    low = np.frombuffer(low, np.uint32).astype(np.int64) | (bucket << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(np.frombuffer(times, kind).astype(np.int64))], schema=unpacked)

        for batch in _in_duckdb(rows(), unpacked, f"select key & 4294967295 as low from parts group by key having sum(times) >= {int(least)}"):
            yield batch.cast(pa.schema([("low", pa.int64())]))

    hashes = found.select("lang", "piece", "times").transform(map_batches, scan, "bucket int, low binary, times binary")
    lows = cut_lineage(hashes.repartition("bucket").transform(map_batches, add_up, "low long"))
    bits = 1 << 16
    while bits < min(SIEVE_BITS * lows.count(), MOST_BITS):
        bits *= 2
    slot = F.col("low") % bits
    sieve = np.zeros(bits // 8, np.uint8)
    for row in lows.select(F.shiftright(slot, 16).alias("part"), (slot % 65536).cast("int").alias("bit")).distinct().groupBy("part").agg(F.collect_list("bit").alias("bits")).toLocalIterator():
        own = np.zeros(1 << 16, bool)  # a row for 65,536 bits at most
        own[row["bits"]] = True
        sieve[row["part"] << 13 : (row["part"] + 1) << 13] = np.packbits(own, bitorder="little")
    return spark.sparkContext.broadcast(sieve)


def weighted_grams(found: DataFrame, sieves: dict[int, object]) -> DataFrame:
    """(lang, phrase, times): n-grams of pieces that pass the sieve for their number of words, added up in tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            langs = batch.column("lang")
            seeds, times = _seeds(langs.to_pylist()), batch.column("times").to_numpy()
            for first, last, data, bounds in slices(batch.column("piece")):
                words = split(data, bounds, _WORD)
                for n, sieve in sieves.items():
                    at = _fitting(words, seeds[first:last], n, (n, sieve.value))
                    if not len(at):
                        continue
                    # words of a piece have one space between them, so a phrase is a stretch of its bytes
                    start, size = words.start[at], words.end[at + n - 1] - words.start[at]
                    to = np.cumsum(size)
                    text = words.data[np.arange(to[-1]) + np.repeat(start - (to - size), size)]
                    phrase = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(0, to).astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
                    row = first + words.row[at]
                    held.append(pa.table({"lang": langs.take(pa.array(row)), "phrase": phrase, "times": pa.array(times[row])}))
                    rows += len(at)
                if rows > HELD_GRAMS:
                    yield from sums(held)
                    held, rows = [], 0
        if held:
            yield from sums(held)

    def sums(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        total = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("times", "sum")]).rename_columns(["lang", "phrase", "times"])
        total = total.set_column(1, "phrase", total.column("phrase").cast(pa.large_string()))
        yield from total.to_batches(max_chunksize=100_000)

    return found.select("lang", "piece", "times").transform(map_batches, scan, "lang string, phrase string, times long")


def frequent(parts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases that occur ``least`` times or more; every hash bucket is added up by DuckDB, out of core."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            for batch in _in_duckdb(chain([first], batches), first.schema, f"select lang, phrase, sum(times)::bigint as f from parts group by all having f >= {int(least)}"):
                yield batch.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))

    return parts.repartition("lang", "phrase").transform(map_batches, add_up, "lang string, phrase string, f long")


def _first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (lang, phrase, a, words) with l, r and score of the cut that counts; every part's count is asked for where it is."""
    cut = lambda k: (_first_words(F.col("phrase"), k), F.expr(f"substring_index(phrase, ' ', {k} - words)"))  # noqa: E731  first k words, the others
    asks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")) for k in (1, 2, 3) for side, part in enumerate(cut(k))))
    requests = candidates.select("lang", "phrase", "a", F.inline(F.filter(asks, lambda x: x["k"] < F.col("words"))))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    f = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    back = answers.groupBy("lang", "phrase", "a").agg(*(f(k, side).alias(f"{'lr'[side]}{k}") for k in (1, 2, 3) for side in (0, 1)))
    score = lambda k: F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), (F.col(f"l{k}") + F.col(f"r{k}")).cast("decimal(20,0)"))
    cuts = F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)))
    return back.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _independent(candidates: DataFrame, inside: int) -> DataFrame:
    """(lang, phrase) of the candidates that do not stand inside a longer one of at least ``inside`` percent of their count."""
    two = lambda start: F.array_join(F.slice(F.col("w"), start, 2), " ")
    three = lambda start: F.array_join(F.slice(F.col("w"), start, 3), " ")
    parts = F.when(F.col("words") == 3, F.array(two(1), two(2))).otherwise(F.array(two(1), two(2), two(3), three(1), three(2)))
    longer = candidates.where("words > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(parts).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * whole("most") < inside * whole("a"))).select("lang", "phrase", "a", "words")


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    found = cut_lineage(pieces(docs))
    spaces = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit("")))
    totals = found.groupBy("lang").agg(F.sum((spaces + 1) * F.col("times")).cast("long").alias("n"))
    words = likely(found, (1,), least)
    pairs = likely(found, (2,), least, (1, words))
    longer = likely(found, (3, 4), least, (2, pairs))
    counts = cut_lineage(frequent(weighted_grams(found, {1: words, 2: pairs, 3: longer, 4: longer}), least))
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), size.alias("words")).where("words > 1")
    scored = _scored(_independent(candidates, inside), counts).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):  # a language's last ranking has at most RANKED * top rows
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(small_side(cut_lineage(totals)), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def oracle(least: int = 30, inside: int = 80, top: int = 2000) -> str:
    """The same in DuckDB SQL."""
    return f"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_extract_all(text, '[^.,;:!?\\x0A-\\x0D]+')) as piece from t),
w as (select lang, w, len(w) as size, m from (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w, count(*) as m from p group by lang, w) where len(w) > 0),
n as (select lang, sum(size * m)::bigint as n from w group by lang),
g as (select lang, size, k, w[i : i + k - 1] as g, m from (select *, unnest(range(1, size - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k) where size >= k)),
f as (select lang, k, array_to_string(g, ' ') as phrase, g, sum(m) as f from g group by lang, k, g having sum(m) >= {least}),
c as (select lang, k, phrase, g, f as a from f where k > 1),
cuts as (select c.lang, c.phrase, c.a, j as k, x.f as l, y.f as r, 2000000::hugeint * c.a // (x.f + y.f) as score from (select *, unnest(range(1, k)) as j from c) c
    join f x on x.lang = c.lang and x.g = c.g[: j] join f y on y.lang = c.lang and y.g = c.g[j + 1 :]),
cut as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (select lang, g[i : i + s - 1] as g, a from (select *, unnest(range(1, k - s + 2)) as i from c, (select unnest([2, 3]) as s) where s < k)),
most as (select lang, g, max(a) as most from inner_parts group by lang, g),
stays as (select c.lang, c.phrase from c left join most on most.lang = c.lang and most.g = c.g where most is null or 100::hugeint * most < {inside} * c.a::hugeint),
ranked as (select cut.*, row_number() over (partition by cut.lang order by score desc, a desc, cut.phrase) as rank from cut join stays on stays.lang = cut.lang and stays.phrase = cut.phrase)
select lang, rank::int as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join n using (lang) where rank <= {top}
"""
