"""Source divergence audit (op13): how far apart the sources of a language are in their use of terms, and by which terms.

Terms are counted by language and source in tasks before they are shuffled, and a language keeps those of at least ``least_docs`` of its documents. A group (a
language's source) gives each kept term the smoothed chance p = 1 + floor(10^9 (count + 2) / (N + 2V)); two chances p and q are
f = floor((p - q)^2 / (p + q)) apart. All arithmetic is on integers, in decimals where products pass 64 bits.

* Terms of a group that stand out from its language: equal counts have equal chances, so a group's terms fall into buckets of counts, and the smallest chance that
  the language gives to a term of a bucket bounds f there. Buckets are evaluated best bound first, twice as many each round, for all groups at once; a
  group stops once every bucket not yet seen has a bound strictly below its k-th value.
* Pairs of sources: a term that neither source has adds the same f for every such term, and one that only one of them has adds what its count says, so these
  come from the number of terms and the histogram of counts. Only what the two sources share is added up term by term, from postings of terms: blocks of
  ``BLOCK`` sources each, so that a row holds a bounded part of a term's postings, and sums are kept as one matrix for two blocks.

Defined results: null text, lang and source are '' each; a row is a document, so repeated rows count repeatedly; a group without terms is there with the chances
of count 0; a language that keeps no term has pairs of value 0; a single source has no pairs; an empty table gives an empty one; texts of any length are taken whole;
ties go by the item's UTF-8 bytes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import cut_lineage, map_batches, small_side

#: Bytes that belong to a term, lower-cased; all others are spaces.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Terms, over all groups, that a task counts together before it hands them on.
HELD = 400_000
#: Sources in a block of postings, and matrices of two blocks that a task adds up before it hands them on.
BLOCK, MATRICES = 128, 400
#: Counts from here on share buckets, eight to each doubling.
EXACT_COUNTS = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; several rows a term, from several tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode().translate(_TERM).split()
                before = len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n) - before
                if held > HELD:
                    yield from handed_on(groups)
                    groups, held = {}, 0
        yield from handed_on(groups)

    def handed_on(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            names = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            counts = [pa.array(x, pa.int64()) for x in (list(n.values()), [docs[t] for t in n])]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(n), pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])

    return _filled(docs).transform(map_batches, scan, "lang string, source string, term string, n long, docs long")


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _chance(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)); 1 if nothing is kept."""
    above = F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below)).otherwise(1).cast("long")


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); chances are at most 10^9 + 1, so the square is below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, all): occurrences in the group and in its language, of the terms that the language keeps."""
    # dealt by language and term once: what groups, and the sums over a language, need no other exchange
    dealt = term_counts(docs).repartition("lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source of the term
    sums = counted.withColumns({"all": F.sum("n").over(term), "_in": F.sum("docs").over(term)})
    return cut_lineage(sums.where(F.col("_in") >= least_docs).select("lang", "source", "term", "n", "all"))


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, sid, kept, own, terms, all, base): each group's number in its language, kept terms of the language, occurrences, different terms, occurrences in the language, chance of count 0."""
    every = _filled(docs).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("terms"))
    # a term has as many rows as sources, and each carries the sum over the language
    lang = kept.select("lang", "term", "all").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("all"))
    joined = every.join(own, ["lang", "source"], "left").join(small_side(lang), "lang", "left").na.fill(0)
    numbered = joined.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return cut_lineage(numbered.withColumn("base", _chance(F.lit(0).cast("long"), F.col("own"), F.col("kept"))))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pairs(kept: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """(lang, a, b, value) of each two sources a < b, by number: f over all kept terms."""
    few = small_side(groups)
    number = F.col("sid") % size
    blocks = groups.withColumn("block", F.floor(F.col("sid") / size)).groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct(number.alias("at"), "base"))).alias("bases"))
    blocks = small_side(cut_lineage(blocks))

    # what a source's terms and those of neither add, against every other source
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("n", "times")).alias("counts"))
    hist = few.join(counts, ["lang", "source"], "left").select("lang", "sid", "kept", "own", "base", "counts").join(blocks, "lang")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, times = (np.array([c[k] for c in row["counts"] or ()], object) for k in ("n", "times"))
                at, base = (np.array([b[k] for b in row["bases"]], np.int64) for k in ("at", "base"))
                p = np.array(1 + (n + 2) * 10**9 // (row["own"] + 2 * row["kept"]) if len(n) else [], np.int64)  # integers of any size first
                none = _f(np.int64(row["base"]), base)
                mine = sum((t * (_f(x, base) - none) for x, t in zip(p, times.tolist(), strict=True)), np.zeros(len(base), np.int64))
                other = row["block"] * size + at
                value = mine + np.where(other > row["sid"], row["kept"], 0) * none
                out += [(row["lang"], min(row["sid"], o), max(row["sid"], o), v) for o, v in zip(other.tolist(), value.tolist(), strict=True) if o != row["sid"]]
            yield _rows(out)

    one = hist.select("lang", "sid", "kept", "own", "base", "counts", "block", "bases").transform(map_batches, alone, "lang string, a long, b long, value long")

    # what the terms that two sources share add to that
    named = kept.join(few.select("lang", "source", "sid", "own", "kept", "base"), ["lang", "source"])
    entry = F.struct(number.alias("at"), _chance(F.col("n"), F.col("own"), F.col("kept")).alias("p"), "base")
    postings = cut_lineage(named.groupBy("lang", "term", F.floor(F.col("sid") / size).alias("block")).agg(F.collect_list(entry).alias("held")))
    several = not groups.where(F.col("sid") >= size).isEmpty()
    if several:
        other = postings.select("lang", "term", F.col("block").alias("block_b"), F.col("held").alias("held_b"))
        met = postings.join(other, ["lang", "term"]).where("block <= block_b")
    else:
        met = postings.withColumns({"block_b": F.col("block"), "held_b": F.col("held")})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "block_b")), strict=True)
            sides = [_lists(batch.column(c)) for c in ("held", "held_b")]
            for i, key in enumerate(keys):
                (at, p, low), (at_b, q, low_b) = ([x[s:e] for x in cells] for cells, s, e in ((cells, ends[i], ends[i + 1]) for cells, ends in sides))
                p, low = p[:, None], low[:, None]
                if key not in sums:
                    if len(sums) >= MATRICES:
                        yield from map(_rows, map(cells_of, sums.items()))
                        sums.clear()
                    sums[key] = np.zeros((size, size), np.int64)
                sums[key][at[:, None], at_b] += _f(p, q) - _f(p, low_b) - _f(low, q) + _f(low, low_b)
        yield from map(_rows, map(cells_of, sums.items()))

    def cells_of(item: tuple[tuple[str, int, int], np.ndarray]) -> list[tuple]:
        (lang, block, block_b), sums = item
        a, b = np.nonzero(sums)
        far = (block < block_b) | (a < b)  # the matrix of a block with itself has each pair twice
        a, b = a[far], b[far]
        return [(lang, i, j, v) for i, j, v in zip((a + block * size).tolist(), (b + block_b * size).tolist(), sums[a, b].tolist(), strict=True)]

    two = met.select("lang", "block", "held", "block_b", "held_b").transform(map_batches, shared, "lang string, a long, b long, value long")
    return one.union(two).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _lists(column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of all structs of a list column, and where each row's start and end in them."""
    ends = column.offsets.to_numpy()
    inner = column.values
    return [inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "p", "base")], ends


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cells = zip(*found, strict=True) if found else [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["lang", "a", "b", "value"])


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows (lang, source, item, value) of each group, with their rank; every task first drops what cannot be among them."""
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _standing_out(kept: DataFrame, groups: DataFrame, k: int, first_round: int = 4) -> DataFrame:
    """(lang, source, item, value, rank): the k terms of each group by which it is furthest above its language."""
    few = small_side(groups.select("lang", "source", "own", "kept", F.col("all").alias("lang_all")))
    named = kept.join(few, ["lang", "source"])
    bucket = F.when(F.col("n") < EXACT_COUNTS, F.col("n")).otherwise(EXACT_COUNTS + F.floor(F.log2("n") * 8)).cast("int")
    p, q = _chance(F.col("n"), F.col("own"), F.col("kept")), _chance(F.col("all"), F.col("lang_all"), F.col("kept"))
    terms = cut_lineage(named.select("lang", "source", bucket.alias("bucket"), F.col("term").alias("item"), p.alias("p"), q.alias("q")))
    # f grows with p and falls with q as long as p > q
    bounds = terms.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")  # some hundred buckets a group
    buckets = cut_lineage(bounds.select("lang", "source", "bucket", _apart(F.col("p"), F.col("q")).alias("bound")).withColumn("at", F.row_number().over(order)))
    best, seen, step, left = terms.limit(0).select("lang", "source", "item", F.lit(0).cast("long").alias("value")), 0, first_round, buckets
    while not left.isEmpty():
        chosen = left.where(F.col("at") <= seen + step).select("lang", "source", "bucket")
        found = terms.join(small_side(chosen), ["lang", "source", "bucket"]).where("p > q").select("lang", "source", "item", _apart(F.col("p"), F.col("q")).alias("value"))
        best = cut_lineage(_first(best.union(found), k).drop("rank"))
        last = best.groupBy("lang", "source").agg(F.min("value").alias("last"), F.count("*").alias("n")).where(F.col("n") == k)
        seen, step = seen + step, step * 2
        left = buckets.where(F.col("at") > seen).join(small_side(last), ["lang", "source"], "left").where("last is null or bound >= last").select(*buckets.columns)
    return _first(best, k)


def audit(docs: DataFrame, least_docs: int = 10, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has every other source of the language, part 'term' the k terms that stand out most."""
    kept = _kept_terms(docs, least_docs)
    groups = _groups(docs, kept)
    pairs = _pairs(kept, groups, block)
    both = pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))), "value")
    names = small_side(groups.select("lang", "sid", "source"))
    both = both.join(names, ["lang", "sid"]).join(names.withColumnsRenamed({"sid": "other", "source": "item"}), ["lang", "other"])
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long"), F.col("rank").cast("int"))
    return out(ranked, "pair").union(out(_standing_out(kept, groups, k), "term"))


def oracle(least_docs: int = 10, k: int = 10) -> str:
    """The same in DuckDB SQL, term by term over all pairs."""
    return f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct id) >= {least_docs}),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
own as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as own from g left join c using (lang, source) group by 1, 2),
q as (select lang, term, 1 + 1000000000::hugeint * (n + 2) // (total + 2 * v) as q from
    (select lang, term, n, sum(n) over (partition by lang) as total from (select lang, term, sum(n)::hugeint as n from c group by 1, 2)) join v using (lang)),
p as (select own.lang, own.source, kept.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (own + 2 * v) as p
    from own join kept using (lang) join v using (lang) left join c on c.lang = own.lang and c.source = own.source and c.term = kept.term),
pair as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join
    (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select p.lang, p.source, p.term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from
    (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {k}
"""
