"""Queries of look-ups, reference tables, lists in both directions, summaries and ability levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import summaries
from tessera.operators import backs, index, lookup, segment
from tessera.plans.catalog import query, table
from tessera.sources import reference


@query("select n_nationkey, n_name from nation where (n_regionkey, n_nationkey) in ((2, 7), (1, 2))")
def detail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity in its partition, and one asked for in another, which is not found."""
    found = [lookup.detail(table(spark, sf_dir, "nation"), "n_regionkey", region, "n_nationkey", nation) for region, nation in ((2, 7), (1, 2))]
    return found[0].union(found[1]).select("n_nationkey", "n_name")


@query("select n_nationkey, n_name from nation where lower(n_name) in ('nation_7', 'no such nation')")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [lookup.by_name(table(spark, sf_dir, "nation"), "n_name", name, "n_nationkey") for name in ("nAtIoN_7", "no such nation")]
    return found[0].union(found[1]).select("n_nationkey", "n_name")


@query("""
with wanted as (select unnest(['nation_2', 'tion_1', 'brazil']) as w)
select w, n_nationkey, n_name from wanted join nation on contains(lower(n_name), w) qualify row_number() over (partition by w order by (lower(n_name) <> w)::int, n_nationkey desc) = 1""")
def part_of_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that equals what is asked for goes before later ones that only contain it; of ties the highest key counts; one is nowhere."""
    nations = table(spark, sf_dir, "nation").withColumn("_order", -F.col("n_nationkey"))
    found = [lookup.by_part_of_name(nations, "n_name", w.upper(), "_order").select(F.lit(w).alias("w"), "n_nationkey", "n_name") for w in ("nation_2", "tion_1", "brazil")]
    return found[0].union(found[1]).union(found[2])


@query("select distinct lang, source from documents where lang is not null and source is not null")
def partition_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.listing(table(spark, sf_dir, "documents"), "lang", "source")


@query("select doc_id, n_chars from documents where lang = 'de'")
def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_partition(table(spark, sf_dir, "documents"), "lang", "de").select("doc_id", "n_chars")


@query("select p_brand, (p_size % 4)::int as level, arg_max(p_name, p_partkey) as p_name, max(p_partkey) as p_partkey from part group by all")
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 4).cast("int").alias("level"), "p_name", "p_partkey")
    return lookup.last_wins(rows, ["p_brand", "level"], ["p_partkey"])


@query("select lower(split_part(p_name, ' ', 1)) as key, arg_max(p_brand, p_partkey) as p_brand from part where p_name <> '' group by 1")
def assignment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(reference.first_name(F.col("p_name")).alias("key"), "p_brand", "p_partkey").where("key <> ''")
    return lookup.last_wins(rows, ["key"], ["p_partkey"]).select("key", "p_brand")


@query("""
select c_custkey, coalesce(r_name, 'unknown') as r_name from customer left join (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where r_regionkey < 3) on c_nationkey = n_nationkey""")
def region_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_regionkey < 3")
    known = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return lookup.with_default(rows, known, F.col("c_nationkey") == F.col("n_nationkey"), {"r_name": "unknown"}).drop("c_nationkey")


@query("""
select s_suppkey, coalesce(c_mktsegment, '') as c_mktsegment from supplier left join (select lower(replace(c_name, 'Customer', 'supplier')) as link, c_mktsegment from customer where c_custkey % 2 = 0) on lower(s_name) = link""")
def link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lower(F.replace("c_name", F.lit("Customer"), F.lit("supplier"))).alias("link"), "c_mktsegment")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return lookup.with_default(rows, links, F.lower("s_name") == F.col("link"), {"c_mktsegment": ""}).drop("s_name")


@query("""
with p as (select distinct l_returnflag as flag, l_linestatus || l_linenumber as trait from lineitem)
select flag, string_agg(trait, ',' order by trait) as traits, count(*) as n from p group by flag""")
def traits_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lists(_traits(spark, sf_dir), "flag", "trait").select("flag", F.array_join("partners", ",").alias("traits"), "n")


@query("""
with p as (select distinct l_returnflag as flag, l_linestatus || l_linenumber as trait from lineitem)
select trait, string_agg(flag, ',' order by flag) as flags, count(*) as n from p group by trait having count(*) > 1""")
def entities_of_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lists(_traits(spark, sf_dir), "trait", "flag", least=2).select("trait", F.array_join("partners", ",").alias("flags"), "n")


@query("""
with p as (select distinct l_returnflag as flag, l_linestatus || l_linenumber as trait from lineitem), w(trait) as (values ('F1'), ('O7'), ('Z9'))
select w.trait, coalesce(string_agg(flag, ',' order by flag), '') as flags from w left join p using (trait) group by w.trait""")
def trait_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("F1",), ("O7",), ("Z9",)], "trait string")
    return index.partners_of(_traits(spark, sf_dir), wanted, "trait", "flag").select("trait", F.array_join("partners", ",").alias("flags"))


def _traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("trait"))


@query("select p_brand, bool_or(p_size > 49) as conditional, string_agg(distinct p_type, ',' order by p_type) as conditions from part group by p_brand")
def conditions_of_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 49).alias("conditional"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("conditions"))


@query("""
select p_partkey, concat_ws(' | ', case when p_size % 2 = 0 then 'Conditional: ' || p_type || ', ' || p_brand end, case when p_size % 3 > 0 then 'Rerolls: ' || (p_size % 3) || ' (free)' end,
  case when p_size % 4 > 0 or p_size % 5 > 0 then 'Healing: ' || (p_size % 4) || ' wounds, ' || (p_size % 5) || ' stress' end, case when p_size % 7 > 0 then 'Defensive: ' || (p_size % 7) || ' wounds, 0 sanity' end) as improvements from part""")
def improvement_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = lambda n: F.col("p_size") % n
    conditions = F.when(mod(2) == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>"))
    made = summaries.improvements(conditions, mod(3), F.lit("free"), mod(4), mod(5), mod(7), F.lit(None).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(made, " | ").alias("improvements"))


@query("""
select n_nationkey, coalesce(h.figure, f.figure) as figure from nation left join (values (3, 'by hand'), (4, 'by hand too')) h(id, figure) on n_nationkey = h.id
  left join (select lower(trim(r_name)) as name, 'region ' || r_regionkey as figure from region union all select 'nation_7', 'a name' union all select 'nation_3', 'not this one' union all select 'canada', 'another') f on lower(n_name) = f.name and len(n_name) >= 3""")
def known_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = spark.createDataFrame([(3, "by hand"), (4, "by hand too")], "id int, figure string")
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("figure"))
    figures = regions.union(spark.createDataFrame([(" Nation_7", "a name"), ("nation_3", "not this one"), ("CANADA", "another")], "name string, figure string"))
    return lookup.known_figure(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", manual, figures).select("n_nationkey", "figure")


@query("select p_partkey, case when p_size > 40 then 'fixed ' || p_partkey else p_name end as p_name, p_size > 40 as changed from part")
def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    manual = parts.where("p_size > 40").select("p_partkey", F.concat(F.lit("fixed "), F.col("p_partkey").cast("string")).alias("p_name"))
    return lookup.overridden(parts.select("p_partkey", "p_name"), manual, ["p_partkey"], "p_name")


@query("select doc_id from labels where nullif(quality, 0) is null or nullif(toxic, 1) is null")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("quality"), F.nullif("toxic", F.lit(1)).alias("toxic"))
    return lookup.pending(rows, ["quality", "toxic"]).select("doc_id")


@query("""
select o_custkey, arg_max(o_orderkey, o_orderkey) filter (where o_orderstatus <> 'F') as front, arg_max(o_orderkey, o_orderkey) filter (where o_orderstatus = 'F') as back from orders group by o_custkey""")
def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.pairs_by_side(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey", "o_orderkey")


@query("""
select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus not in ('F', 'O')) as other from orders group by o_orderpriority""")
def update_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.status_counts(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus"), ["F", "O"])


@query("select n_regionkey, count(*) as n, string_agg(n_name, ', ' order by n_nationkey) as names from nation group by n_regionkey")
def pool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["n_name"]), ", ").alias("names"))


@query("select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, strftime(ts, '%Y-%m-%d') as day from events")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.col("ts").cast("timestamp")
    iso = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", summaries.file_stamp(moment).alias("stamp"), summaries.date_part(iso).alias("day"))


_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as pos from documents"


@query(f"select doc_id, pos from ({_LINES}) where len(trim(line, ' ')) > 60 or contains(upper(line), 'DICE') or contains(upper(line), 'LICENSE')")
def description_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.lines(table(spark, sf_dir, "documents"), "doc_id")
    return rows.where(summaries.is_description(F.col("line"), ["DICE", "LICENSE"])).select("doc_id", "pos")


@query("""
with c as (select conv_id, turn, trim(regexp_replace(regexp_replace(text || ' THE BLACKGOAT walks', '\\s+[A-Z]{6,}\\b', '', 'g'), '\\s+', ' ', 'g'), ' ') as clean from conversations)
select conv_id, turn, md5(case when len(clean) > 20 and regexp_matches(clean, '[A-Za-z]$') then clean || '.' else clean end) as clean from c""")
def capitals_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = summaries.without_capitals(F.concat("text", F.lit(" THE BLACKGOAT walks")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(clean.cast("binary")).alias("clean"))


def numbered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with every other line numbered as a level of a card is."""
    mark = lambda x, i: F.when(i % 2 == 0, F.concat((i % 4 + 1).cast("string"), F.lit(". "), x)).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


#: Names that begin powers in ``back_text_powers``.
BACK_NAMES = ["token", "the reed", "und sich", "la que", "mente ado"]


@query()
def ability_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that lines of whole documents open; SQL would need a fold over lines, so the tests recompute them."""
    return segment.levels(numbered_text(spark, sf_dir), "doc_id")


@query()
def back_text_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers that whole documents, read as backs of cards, have by name; the tests recompute them line by line."""
    found = backs.back_powers(numbered_text(spark, sf_dir), "doc_id", BACK_NAMES)
    return found.select(F.col("id").alias("doc_id"), "special", "pos", "name", F.size("levels").alias("n_levels"), F.md5(F.array_join("levels", "|").cast("binary")).alias("digest"))


@query("""
with e as (select p_partkey, p_brand, (p_size % 4)::int as level from part), t as (select p_brand, (p_size % 4)::int as level, min(p_name) as truth from part where p_size > 25 group by all)
select p_partkey, truth is not null as known from e left join t using (p_brand, level)""")
def description_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.col("p_size") % 4).cast("int").alias("level")
    parts = table(spark, sf_dir, "part")
    truth = parts.where("p_size > 25").groupBy("p_brand", level).agg(F.min("p_name").alias("truth"))
    return parts.select("p_partkey", "p_brand", level).join(truth, ["p_brand", "level"], "left").select("p_partkey", F.col("truth").isNotNull().alias("known"))
