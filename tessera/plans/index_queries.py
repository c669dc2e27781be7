"""Queries over index files, which they write to the session's shared folder first, and over sections of documents."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import anchors, index
from tessera.plans.catalog import _FACET_SQL, _FACETS, _customers, query, table
from tessera.sources import index_files, versions


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or in the temporary folder where that is unset on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or os.path.join(tempfile.gettempdir(), 'tessera-checkpoints')}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, entries: DataFrame, name: str) -> index_files.Index:
    path = scratch(spark, name)
    index_files.write(entries, path)
    return index_files.load(spark, path)


@query(f"""
with h as (select distinct facet, key, id from ({_FACET_SQL}) where key <> '')
select facet, key, count(*) as n, sum(id)::bigint as id_sum, min(id) as lowest, max(id) as highest from h
where (facet, key) in (('segment', 'BUILDING'), ('region', 'ASIA'), ('nation', 'NATION_3'), ('nation', 'nowhere')) group by facet, key""")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of given keys, from the files of their buckets alone."""
    found = _written(spark, index.facets(_customers(spark, sf_dir), {k: F.col(v) for k, v in _FACETS.items()}, "c_custkey"), "customer-index")
    ids = found.lookup([("segment", "BUILDING"), ("region", "ASIA"), ("nation", "NATION_3"), ("nation", "nowhere")])
    return ids.groupBy("facet", "key").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.min("id").alias("lowest"), F.max("id").alias("highest"))


@query(f"""
with h as (select distinct id from ({_FACET_SQL}) where contains(lower(key), '1') and facet in ('nation', 'name'))
select c_mktsegment, count(*) as n from customer where c_custkey in (select id from h) group by c_mktsegment""")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of keys: the table of keys says which buckets hold them."""
    found = _written(spark, index.facets(_customers(spark, sf_dir), {k: F.col(v) for k, v in _FACETS.items()}, "c_custkey"), "customer-index")
    return index.grouped_hits(found.search(" 1 ", ["nation", "name"]), table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


_WORDS = "select distinct doc_id as id, unnest(string_split(lower(text), ' ')) as key from documents"


@query(f"select key, count(*) as n, sum(id)::bigint as id_sum, max(id) as highest from ({_WORDS}) where key <> '' group by key")
def index_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every text as a key: what the blocks hold, unfolded and summed by key. A text's repeats of a word stay in its row."""
    words = table(spark, sf_dir, "documents").select(F.lit("word").alias("facet"), F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("key"), F.col("doc_id").alias("id"))
    return index_files.totals(_written(spark, words, "word-index").blocks).select("key", "n", "id_sum", "highest")


# ---- sections that begin at names

_NAMES = ["token", "the", "in the", "de la", "la", "und der", "und", "el que", "nowhere at all"]
_SECTIONS = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
v as (select doc_id, n, list_filter(string_split(line, ' '), lambda x: x <> '') as ws from l),
u as (select doc_id, n, unnest(ws) as word, generate_subscripts(ws, 1) as k from v),
w as (select *, row_number() over (partition by doc_id order by n, k) - 1 as pos from u),
x as (select *, lower(word) as a, lower(lead(word) over (partition by doc_id order by pos)) as b from w),
names as (select name, split_part(name, ' ', 1) as a, nullif(split_part(name, ' ', 2), '') as b from (select unnest({_NAMES[:-1]!r}) as name)),
anchor as (select doc_id, pos, name, case when names.b is null then 1 else 2 end as size from x join names on x.a = names.a and (names.b is null or x.b = names.b)
    qualify row_number() over (partition by doc_id, pos order by size desc, name desc) = 1),
kept as (select * from anchor qualify coalesce(max(pos + size) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) <= pos),
s as (select doc_id, name, pos as s, lead(pos) over (partition by doc_id order by pos) as e, row_number() over (partition by doc_id, name order by pos) as occurrence from kept)
"""


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n.upper(),) for n in _NAMES], "name string")


@query(f"""{_SECTIONS}
select doc_id, name, s as start, count(*) as n_words, count(distinct n) as n_lines, md5(string_agg(word, ' ' order by pos)) as digest
from s join x using (doc_id) where occurrence = 1 and pos >= s and (e is null or pos < e) group by doc_id, name, s""")
def name_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section of each name in each whole document."""
    found = anchors.section_texts(table(spark, sf_dir, "documents"), "doc_id", _names(spark))
    size = F.size(F.split("text", "\n"))
    return found.select(F.col("id").alias("doc_id"), "name", F.col("start").cast("long"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), size.cast("long").alias("n_lines"), F.md5(F.replace("text", F.lit("\n"), F.lit(" ")).cast("binary")).alias("digest"))


@query(f"""{_SECTIONS}
select doc_id, name, count(distinct occurrence) as n_sections, count(distinct (occurrence, n)) as n_parts, count(*) as n_words
from s join x using (doc_id) where pos >= s and (e is null or pos < e) group by doc_id, name""")
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the sections of each name reach into."""
    met = anchors.lines_of_sections(table(spark, sf_dir, "documents"), "doc_id", _names(spark))
    return met.groupBy(F.col("id").alias("doc_id"), "name").agg(F.countDistinct("occurrence").alias("n_sections"), F.count("*").alias("n_parts"), F.sum("words").cast("long").alias("n_words"))


# ---- nested documents


@query("""
with n as (select c_custkey::bigint as id, 'X' || c_mktsegment as segment, c_acctbal as balance, [c_custkey::bigint] as marks from customer where c_acctbal < 0
  union all select 1000000000 + s_suppkey, s_name, s_acctbal, [] from supplier)
select coalesce(c_custkey::bigint, n.id) as id, coalesce(c_name, 'supplier') as name, c_nationkey as nation, coalesce(n.segment, c_mktsegment) as segment, n.balance,
  case when n.id is null then 2 when c_custkey is null then 0 else 1 end as n_marks, coalesce(n.marks[1], c_nationkey::bigint) as mark
from customer full join n on c_custkey = n.id""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to nested documents, merged into a version of a table and read back from the next."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = F.col("c_nationkey").cast("long")
    before = customers.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("segment")).alias("market")).alias("place"), F.array(nation, nation).alias("marks"))
    market = lambda segment, balance: F.struct(F.struct(segment.alias("segment"), F.col(balance).alias("balance")).alias("market")).alias("place")
    negative = customers.where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("id"), F.lit("").alias("name"), market(F.concat(F.lit("X"), "c_mktsegment"), "c_acctbal"), F.array(F.col("c_custkey").cast("long")).alias("marks"))
    added = suppliers.select((1_000_000_000 + F.col("s_suppkey")).alias("id"), F.lit("supplier").alias("name"), market(F.col("s_name"), "s_acctbal"), F.array().cast("array<bigint>").alias("marks"))
    path = scratch(spark, "entities")
    versions.write(before, path)
    versions.write_changes(negative.union(added), path, "id")
    after = versions.read(spark, path)
    return after.select("id", "name", F.col("place.nation").alias("nation"), F.col("place.market.segment").alias("segment"), F.col("place.market.balance").alias("balance"), F.size("marks").alias("n_marks"), F.get("marks", F.lit(0)).alias("mark"))
