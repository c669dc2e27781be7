"""More queries on cards: sentences, names, levels, places, tracks and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import facts, names, scoring, text, tracks
from tessera.operators import levels, places, segment
from tessera.plans.catalog import _BLACK_SQL, _CONVERSION_SQL, _FACTOR_SQL, _GREEN_SQL, EFFECT, _number_sql, effects, query, table


@query(f"""
with f as (select p_partkey, ({_GREEN_SQL})::int as g, ({_BLACK_SQL})::int as b, ({_CONVERSION_SQL})::int as c, ({_FACTOR_SQL})::int as k, ({_number_sql(facts.ACTIONS)})::int as a from (select p_partkey, {EFFECT} as effect from part))
select p_partkey, coalesce(nullif(concat_ws('. ', case when g + b > 0 then 'Adds ' || concat_ws(' + ', case when g > 0 then g || ' green dice' end, case when b > 0 then b || ' black dice' end) end,
  case when c >= 999 and k > 1 then 'Counts any elder signs as ' || k || ' successes each' when c >= 999 then 'Counts any elder signs as successes' when c > 0 then 'Counts ' || c || ' elder sign(s) as success(es)' end,
  case when a = 1 then 'Adds 1 free attack per turn' when a > 1 then 'Adds ' || a || ' free attacks per turn' end), ''), '{names.NO_EFFECT}') as sentence from f""")
def effect_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("effect")
    made = names.effect_sentence(facts.green_dice(e), facts.black_dice(e), facts.conversion(e), facts.conversion_factor(e), facts.free_actions(e), facts.action_kind(e))
    return effects(spark, sf_dir).select("p_partkey", made.alias("sentence"))


_SPEC = "case p_size % 5 when 0 then p_brand when 1 then concat(p_brand, ':x') when 2 then 'Nobody:1' else concat(p_brand, ':', cast(p_size % 7 as string)) end"


@query(f"""
with l as (select distinct p_brand as name, (p_size % 4 + 1)::int as level from part), s as (select p_partkey, {_SPEC} as spec from part),
p as (select p_partkey, contains(spec, ':') as colon, split_part(spec, ':', 1) as name, try_cast(split_part(spec, ':', 2) as int) as level from s)
select p_partkey, case when not colon then 'malformed' when level is null then 'no level' when name not in (select name from l) then 'unknown name' when (name, level) not in (select (name, level) from l) then 'unknown level' else 'found' end as status from p""")
def spec_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.col("p_brand").alias("name"), (F.col("p_size") % 4 + 1).cast("int").alias("level"))
    return levels.resolve(parts.select("p_partkey", F.expr(_SPEC).alias("spec")), "spec", known).select("p_partkey", "status")


@query("""
with k as (select distinct l_partkey from lineitem), s as (select l_partkey, unnest(range(1, 5))::int as level from k),
t as (select l_partkey, l_linenumber::int as level, min(l_returnflag) as truth from lineitem where l_quantity > 10 group by all), f as (select l_partkey, l_linenumber::int as level, max(l_returnflag) as found from lineitem where l_quantity < 40 group by all)
select l_partkey, avg(case when truth is null then 50.0::double when found is null then 0 when truth = found then 100 else 40 end) as score from s left join t using (l_partkey, level) left join f using (l_partkey, level) group by l_partkey""")
def level_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").cast("int").alias("level"), "l_returnflag", "l_quantity")
    truth = lines.where("l_quantity > 10").groupBy("l_partkey", "level").agg(F.min("l_returnflag").alias("truth"))
    found = lines.where("l_quantity < 40").groupBy("l_partkey", "level").agg(F.max("l_returnflag").alias("found"))
    score = F.when(F.col("truth").isNull(), 50.0).when(F.col("found").isNull(), 0.0).when(F.col("truth") == F.col("found"), 100.0).otherwise(40.0)
    return levels.compared(lines, "l_partkey", truth, found, score)


@query("""
with v as (select role, (turn % 4 + 1)::int as level, conv_id, turn, text from conversations where len(text) > 5 and len(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 5 > len(text) and not contains(text, 'Not found')),
b as (select role, level, text from v qualify row_number() over (partition by role, level order by len(text) desc, conv_id, turn, text) = 1), s as (select role, unnest(range(1, 5))::int as level from (select distinct role from conversations))
select role, level, md5(coalesce(text, 'Not found')) as text from s left join b using (role, level)""")
def best_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", "text")
    best = levels.best_extraction(rows, "role", (F.col("turn") % 4 + 1).cast("int"), "text", ["conv_id", "turn"], names.valid_extraction(F.col("text")))
    return best.withColumn("text", F.md5(F.col("text").cast("binary")))


@query("""
with c as (select role, case when text is null or len(trim(text)) < 5 then 1 else (len(text) > 500)::int + regexp_matches(text, '[|]{2,}')::int + regexp_matches(text, '[~]{2,}')::int + regexp_matches(text, '[^0-9A-Za-z_\\s.,;:!?\\-()\\[\\]/]{3,}')::int end as n from conversations)
select case when grouping(role) = 1 then '*' else role end as role, count(*) as analysed, sum(n)::bigint as issues, count(*) filter (n > 0) as affected from c group by rollup (role)""")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.issue_rollup(table(spark, sf_dir, "conversations"), "role", scoring.validity_issues(F.col("text")))


@query("""
with w as (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) as w, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) as pos from documents),
c as (select doc_id, w, min(pos) as pos from w where len(w) > 3 group by doc_id, w having count(*) > 3), t as (select *, row_number() over (partition by doc_id order by pos) as k from c)
select doc_id, string_agg(w, ' ' order by pos) as words from t where k <= 3 group by doc_id""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of the words that a document repeats most plainly; documents without any are left out."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(scoring.frequent_words(F.col("text")), 1, 3), " ").alias("words"))
    return words.where("words <> ''")


_SPOT = "case c_custkey % 3 when 0 then lower(n_name) when 1 then concat(n_name, ', Somewhere') else 'Nowhere' end"
_LOCATED = f"""with p as (select c_custkey, {_SPOT} as place from customer join nation on c_nationkey = n_nationkey),
l as (select c_custkey, n_nationkey::double as lat, n_regionkey::double as lon from p left join nation on upper(split_part(place, ',', 1)) = upper(n_name))"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_SPOT).alias("place"))
    gazetteer = nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lon"))
    return places.locate(rows.withColumn("city", F.get(places.parts(F.col("place")), F.lit(0))), "place", "city", gazetteer)


@query(f"{_LOCATED} select * from l")
def place_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("c_custkey", "lat", "lon")


@query(f"{_LOCATED} select lat, lon, count(*) as entities, min(c_custkey) as first from l where lat is not null group by lat, lon")
def marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.markers(_located(spark, sf_dir), "lat", "lon", "c_custkey")


@query("""
with s as (select p_partkey, (p_size % 7)::int as before, (p_size % 4)::int as n from part)
select p_partkey, least(6, before + n)::int as damage, greatest(0, 5 - least(6, before + n))::int as health, greatest(0, before - n)::int as healed, least(5, before + n)::int as stress from s""")
def health_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, n = F.expr("cast(p_size % 7 as int)"), F.expr("cast(p_size % 4 as int)")
    hurt = tracks.damage(before, n)
    return table(spark, sf_dir, "part").select("p_partkey", hurt.alias("damage"), tracks.health(hurt).alias("health"), tracks.heal(before, n).alias("healed"), tracks.stress(before, n).alias("stress"))


@query("""
select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[^0-9A-Za-z_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) filter ((regexp_matches(line, '[A-Z]') and line = upper(line) and len(line) between 4 and 99) or regexp_matches(line, '^[A-Z][a-z]+(\\s+[A-Z][a-z]+)+$')) as headers from l group by doc_id""")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.lines(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count_if(text.header_line(F.col("line"))).alias("headers"))


_REFERENCES = "concat('Lord ', c_mktsegment, ' (', cast(c_custkey as string), '), nobody, Dr. ', c_mktsegment, ' Old(', cast(c_nationkey as string), ')')"


@query(f"""
with p as (select c_custkey, unnest(string_split({_REFERENCES}, ',')) as part from customer)
select c_custkey, trim(regexp_extract(part, '([A-Z][a-zA-Z\\s''\\-\\.]+?)\\s*\\((\\d+)\\)', 1)) as name, regexp_extract(part, '([A-Z][a-zA-Z\\s''\\-\\.]+?)\\s*\\((\\d+)\\)', 2)::int as number from p where regexp_matches(part, '([A-Z][a-zA-Z\\s''\\-\\.]+?)\\s*\\((\\d+)\\)')""")
def name_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(names.references(F.expr(_REFERENCES))))


@query(f"""
with n as (select c_custkey, {_REFERENCES} as t from customer)
select c_custkey, lower(regexp_extract(regexp_replace(regexp_replace(t, '\\s*\\(\\d+\\)', '', 'g'), '(?i)^(lord|professor|sergeant|dr\\.|dr)\\s+', ''), '^\\s*(\\S*)', 1)) as key,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^(lord|lady|sir|dame|dr\\.?|doctor|professor|prof\\.?|sergeant|sgt\\.?|captain|capt\\.?|lieutenant|lt\\.?)\\s+', ''), '[^0-9A-Za-z_\\s]', '', 'g'), '\\s+', ' ', 'g'))) as plain from n""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(_REFERENCES)
    return table(spark, sf_dir, "customer").select("c_custkey", names.name_key(t).alias("key"), names.plain_name(t).alias("plain"))


@query()
def motto_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-references, which DuckDB's expressions do not have."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(names.clean_motto(F.col("text")).cast("binary")).alias("motto"))
