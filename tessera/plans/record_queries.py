"""Queries over stories, named strategies, accepted names, sort states, fields of several shapes, and sentences of every effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cards, facts, rules, scoring, statistics, strategies, text, variants
from tessera.operators import acceptance, paragraphs, ranking
from tessera.plans.catalog import _TYPES, EFFECT, ORACLE_SQL, effects, query, table

# ---- paragraphs

_BAG = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


def _score_sql(p: str) -> str:
    words = f"string_split_regex(lower({p}), '\\s+')"
    common = ", ".join(f"'{w}'" for w in cards.STORY_COMMON)
    story = " + ".join(f"contains(lower({p}), '{w}')::int" for w in cards.STORY_WORDS)
    points = f"len({p}) + 5 * len({words}) - 5 * len(regexp_extract_all({p}, '[@#$%^&*|~`]')) + 3 * len(list_filter({words}, lambda w: w in ({common}))) + 10 * ({story})"
    return f"(case when len({p}) <= 80 or (regexp_matches({p}, '[A-Z]') and not regexp_matches({p}, '[a-z]')) then -1000 else {points} - 100 * regexp_matches(upper({p}), '{'|'.join(cards.RULE_WORDS)}')::int end)::int"


def _two_sql(rows: str, key: str) -> str:
    """The best paragraph and its runner-up, joined where that adds to it, of rows (key, i, p)."""
    return f"""s as (select {key}, i, p, {_score_sql('p')} as score from ({rows})),
r as (select *, row_number() over (partition by {key} order by score desc, i, p) as k from s where score > 0),
j as (select a.{key}, a.score, a.p as best, b.p as second, coalesce(a.score > 50 and len(list_intersect({_BAG.format('a.p')}, {_BAG.format('b.p')})) < 0.3 * len({_BAG.format('b.p')}), false) as two
  from r a left join r b on a.{key} = b.{key} and b.k = 2 where a.k = 1)
select {key}, md5(case when two then best || ' ' || second else best end) as story, score, (case when two then 2 else 1 end)::int as parts from j"""


@query(f"""
with q as (select doc_id, text, string_split_regex(text, '\\n\\s*\\n+') as q from documents),
l as (select doc_id, case when len(q) = 1 then string_split(text, chr(10)) else q end as ps from q),
x as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from l),
{_two_sql("select doc_id, i, p from (select doc_id, i, regexp_replace(p, '^\\s+|\\s+$', '', 'g') as p from x) where p <> ''", "doc_id")}""")
def story_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of each whole document, ranked in its row."""
    found = table(spark, sf_dir, "documents").select("doc_id", paragraphs.story(F.col("text")).alias("s")).where("s is not null")
    return found.select("doc_id", F.md5(F.col("s.story").cast("binary")).alias("story"), "s.score", "s.parts")


@query(f"with {_two_sql('select conv_id, turn as i, text as p from conversations', 'conv_id')}")
def story_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best turn of each conversation with its runner-up: paragraphs that are rows."""
    turns = table(spark, sf_dir, "conversations")
    best = paragraphs.best_of_groups(turns, ["conv_id"], "text", "turn", paragraphs.score(F.col("text")))
    return best.select("conv_id", F.md5(F.col("story").cast("binary")).alias("story"), "score", "parts")


# ---- strategies

_WANTED = "case doc_id % 5 when 0 then 'plain' when 1 then 'basic' when 2 then 'numbered' when 3 then 'unheard of' end"
_KNOWN = strategies.registry([strategies.Strategy("plain", [text.whitespace]), strategies.Strategy("basic", [strategies.basic]), strategies.Strategy("numbered", [text.whitespace, strategies.numbered])])


def _rewrites_sql(column: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        column = f"regexp_replace({column}, '{a}', '{b}', 'g')"
    return column


def _basic_sql() -> str:
    out = "text"
    for a, b in rules.LITERAL_CORRECTIONS:
        out = "replace({}, '{}', '{}')".format(out, a.replace("'", "''"), b.replace("'", "''"))
    glyphs = [("[●○◉🟢🟩]", "green dice"), ("(?i)green\\s*dice", "green dice"), ("[■□⬛⬜]", "black dice"), ("(?i)black\\s*dice", "black dice"), ("🌀", "red swirl")]
    glyphs += [(f"(?i){p}", "red swirl") for p in ("red\\s*swirl", "sanity\\s*threshold", "insanity\\s*threshold", "red\\s*sanity\\s*marker")]
    out = _rewrites_sql(out, [*glyphs, ("[ \\t]+", " "), ("(?m)^ | $", ""), ("\\s*[|]\\s*", " "), ("\\s*[~]\\s*", " "), ("[^0-9A-Za-z_\\s.,;:!?\\-()\\[\\]/●○◉🌀■□⬛⬜]", "")])
    return _rewrites_sql(f"trim({out})", [(f"(?i){a}", b) for a, b in strategies.BASIC])


_PLAIN_SQL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_NUMBERED_SQL = _rewrites_sql(_PLAIN_SQL, [*[(f"(?i)\\bI\\s+{noun}\\b", f"1 {noun}") for noun in strategies.COUNTED], *strategies.NAMES])


@query(f"""
with w as (select doc_id, text, coalesce(nullif({_WANTED}, 'unheard of'), 'numbered') as strategy from documents)
select doc_id, strategy, md5(regexp_replace(case strategy when 'plain' then {_PLAIN_SQL} when 'basic' then {_basic_sql()} else {_NUMBERED_SQL} end, '^\\s+|\\s+$', '', 'g')) as cleaned from w""")
def strategy_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts by the chain that their row names; rows that name none or an unknown one take the fallback."""
    done = table(spark, sf_dir, "documents").select("doc_id", strategies.run(F.col("text"), F.expr(_WANTED), _KNOWN, "numbered").alias("r"))
    return done.select("doc_id", "r.strategy", F.md5(F.col("r.text").cast("binary")).alias("cleaned"))


# ---- accepted names

_LISTED = ["the", "de", "und", "la", "that", "des"]


@query(f"""
with w as (select doc_id, string_split(text, ' ') as ws from documents),
x as (select doc_id, unnest(ws) as word, unnest(list_prepend(null, ws[:-2])) as before, generate_subscripts(ws, 1) - 1 as pos from w),
f as (select doc_id, lower(word) as name, min(pos)::int as pos from x where lower(word) in ({', '.join(repr(n) for n in _LISTED)}) and len(before) > 3 group by all)
select doc_id, name, pos, (row_number() over (partition by doc_id order by pos, name))::int as rank from f qualify row_number() over (partition by doc_id order by pos, name) <= 2""")
def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two distinct listed words of each document that stand behind a word of four letters or more."""
    at = scoring.let(F.split("text", " ", -1), lambda words: F.transform(words, lambda w, i: F.struct(F.lower(w).alias("name"), i.alias("pos"), F.get(words, i - 1).alias("before"))))
    listed = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.filter(at, lambda x: x["name"].isin(_LISTED))))
    return acceptance.first_accepted(listed, ["doc_id"], "name", "pos", F.length("before") > 3)


_LINE = "case p_size % 6 when 0 then substr(p_type, 1, p_size % 9 + 1) when 1 then substr(p_type, 4, 9) when 2 then concat(substr(p_type, 1, 6), '.,') when 3 then concat('- ', split_part(p_type, ' ', 1)) when 4 then concat('gain ', substr(p_type, 1, 8)) else split_part(p_type, ' ', 1) end"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in _TYPES])
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(_LINE).alias("line"), F.get(names, F.pmod(F.col("p_partkey"), F.lit(len(_TYPES))).cast("int")).alias("name"), F.expr(EFFECT).alias("before"))
    return acceptance.judged(rows, "line", "name", "before")


@query()
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates say of each part's line; a test runs plain code over the same rows, since SQL has no indel ratio."""
    return _gated(spark, sf_dir).select("p_partkey", "line", "name", "before", "verdict")


@query()
def gated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two names of each brand whose lines pass the gates."""
    return acceptance.first_accepted(_gated(spark, sf_dir), ["p_brand"], "name", "p_partkey", F.col("verdict") == "accepted")


# ---- sort states

_SHOWN = "case when c_custkey % 7 = 0 then null when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end"
_STATE = "case c_nationkey % 3 when 0 then 'asc' when 1 then 'desc' end"


@query(f"""
with c as (select c_custkey, c_nationkey, lower(coalesce({_SHOWN}, '')) as shown, {_STATE} as state from customer),
r as (select c_custkey, c_nationkey, state, (row_number() over (partition by c_nationkey order by case when state = 'asc' then shown end asc nulls first, case when state = 'desc' then shown end desc nulls last, c_custkey))::int as rank from c)
select c_custkey, c_nationkey, state, case state when 'asc' then 'desc' when 'desc' then null else 'asc' end as next, rank from r where rank <= 20""")
def toggle_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each nation's customers, each nation's table in a state of its own."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr(_SHOWN).alias("shown"), F.expr(_STATE).alias("state"))
    page = ranking.ranked(rows, ranking.toggled(F.col("state"), F.col("shown"), F.col("c_custkey")), ["c_nationkey"], 20)
    return page.select("c_custkey", "c_nationkey", "state", ranking.next_state(F.col("state")).alias("next"), "rank")


# ---- fields of several shapes

_JSON = """case c_custkey % 6
  when 0 then concat('{"location":"', c_mktsegment, ', Łódź","id":', cast(c_custkey as string), '}')
  when 1 then concat('{"id":', cast(c_custkey as string), ',"location":{"parsed":{"city":"', c_mktsegment, '","country":null},"original":"', c_name, '"}}')
  when 2 then concat('{"location":', cast(c_nationkey as string), ',"id":', cast(c_custkey as string), '}')
  when 3 then concat('{"id":', cast(c_custkey as string), ',"location":["', c_name, '",true]}')
  when 4 then concat('{"id":', cast(c_custkey as string), '}')
  else concat('{"id":', c_name) end"""


@query(f"""
with j as (select c_custkey, case when json_valid(t) then t::json end as t from (select c_custkey, {_JSON} as t from customer)), k as (select *, json_type(t, '$.location') as kind from j),
l as (select c_custkey, t, case kind when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else case when kind is not null then 'number' end end as kind from k)
select c_custkey, kind, case kind when 'string' then t->>'$.location' when 'object' then t->>'$.location.original' end as original, t->>'$.location.parsed.city' as city, t->>'$.location.parsed.country' as country,
  '{{"id":' || (t->'$.id') || case when kind is null then '' when kind = 'object' then ',"location":{{"original":' || (t->'$.location.original') || ',"parsed":' || (t->'$.location.parsed') || '}}' else ',"location":' || (t->'$.location') end || '}}' as written
from l""")
def json_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of several shapes read from JSON text, and the documents written back with their id first."""
    v = F.col("v")
    docs = table(spark, sf_dir, "customer").select("c_custkey", variants.parsed(F.expr(_JSON)).alias("v"))
    place = variants.fields(v, "$.location").alias("place")
    return docs.select("c_custkey", variants.kind(F.try_variant_get(v, "$.location", "variant")).alias("kind"), place, variants.written(v, ["id"]).alias("written")).select("c_custkey", "kind", "place.*", "written")


# ---- sentences of every effect, whose facts the tables below say outright

_KINDS = [*facts.ACTION_KINDS, "action"]
_DOERS = ["", *[f"Perform 2 extra actions to {k}. " for k in facts.ACTION_KINDS], "Perform 2 free actions. "]
_WHEN = [
    ("", []),
    ("When attacking, ", ["when attacking"]),
    ("While attacking a target not in your space, ", ["when attacking"]),
    ("When attacking a target not in your space, ", ["when attacking", "when attacking target not in your space"]),
    ("When attacking a target in your space, ", ["when attacking", "when attacking target in your space"]),
    ("If sanity is on red, ", ["when sanity is on red sanity marker"]),
    ("When rolling for fire, ", ["when attacked or rolling for fire"]),
]
#: Sentence, wounds and stress healed, wounds and sanity reduced, and the flags of the healing form that hold.
_CARE = [
    ("", 0, 0, 0, 0, []),
    ("heal 2 wounds.", 2, 0, 0, 0, ["heals"]),
    ("heal 3 stress.", 0, 3, 0, 0, ["heals"]),
    ("heal 2 wounds and 3 stress.", 2, 3, 0, 0, ["heals", "both"]),
    ("heal 2 wounds or 1 stress.", 2, 1, 0, 0, ["heals", "either"]),
    ("heal any combination of 2 wounds and stress.", 0, 0, 0, 0, ["heals", "flexible"]),
    ("each investigator heals 1 wound.", 0, 0, 0, 0, ["heals", "each"]),
    ("reduce wounds and loss of sanity by 2.", 0, 0, 2, 2, []),
    ("reduce loss of sanity by 1.", 0, 0, 0, 1, []),
    ("reduce wounds taken by 3.", 0, 0, 3, 0, []),
    ("you are healthy.", 0, 0, 0, 0, []),
]
_FORMS = ["heals", "flexible", "either", "both", "each"]


def _pick(values: list[object], size: int, otherwise: str = "''") -> str:
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"case o_orderkey % {size} " + " ".join(f"when {i} then {literal(v)}" for i, v in enumerate(values)) + f" else {otherwise} end"


_SENTENCE = f"concat({_pick(_DOERS, 8)}, {_pick([w for w, _ in _WHEN], 7)}, {_pick([c[0] for c in _CARE], 11)})"
_CARE_SQL = ", ".join(f"({_pick([c[i] for c in _CARE], 11, '0')})::int as {name}" for i, name in ((1, "wounds_healed"), (2, "stress_healed"), (3, "wound_reduction"), (4, "sanity_reduction")))
_FORM_SQL = ", ".join(f"({_pick([f in c[5] for c in _CARE], 11, 'false')})::boolean as {f}" for f in _FORMS)


@query(f"""
select o_orderkey, (case when o_orderkey % 8 = 0 then 0 else 2 end)::int as actions,
  case when o_orderkey % 8 = 0 or o_orderkey % 7 in (1, 2, 3, 4) then 'attack' else {_pick(['', *_KINDS], 8)} end as action_kind, {_pick([', '.join(c) for _, c in _WHEN], 7)} as conditions, {_CARE_SQL}, {_FORM_SQL} from orders""")
def effect_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of action, condition, healing and reduction; the SQL knows a sentence's facts from what it was made of."""
    e = F.col("effect")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SENTENCE).alias("effect"))
    named = {"actions": facts.free_actions(e), "action_kind": facts.action_kind(e), "conditions": F.array_join(facts.conditions(e), ", "), "wounds_healed": facts.wounds_healed(e), "stress_healed": facts.stress_healed(e), "wound_reduction": facts.wound_reduction(e), "sanity_reduction": facts.sanity_reduction(e)}
    return rows.select("o_orderkey", *[c.alias(k) for k, c in {**named, **facts.heal_grammar(e)}.items()])


# ---- statistics of levels, powers as structs


@query(f"""
with f as ({ORACLE_SQL['effect_facts']}), i as ({ORACLE_SQL['effect_impact']}),
c as (select p_partkey, concat_ws(', ', case when regexp_matches(e, 'when attacking|while attacking') then 'when attacking' end, case when contains(e, 'when attacking a target not in your space') then 'when attacking target not in your space' end,
  case when contains(e, 'when attacking a target in your space') then 'when attacking target in your space' end, case when regexp_matches(e, 'sanity (is )?on red') then 'when sanity is on red sanity marker' end,
  case when regexp_matches(e, 'when attacked|when rolling for fire') then 'when attacked or rolling for fire' end) as conditions from (select p_partkey, lower({EFFECT}) as e from part))
select p_partkey, green as green_dice_added, black as black_dice_added, 1.5::double as base_expected_successes, round(enhanced, 3) as enhanced_expected_successes, round(increase, 3) as expected_successes_increase,
  round(percent, 2) as expected_successes_percent_increase, max_increase as max_successes_increase, round(risk, 3) as tentacle_risk, 1.5::double as base_tentacle_risk, conditions <> '' as is_conditional, conditions,
  rerolls as rerolls_added, reroll_kind as reroll_type, rerolls > 0 as has_reroll, wounds_healed, stress_healed, wounds_healed > 0 or stress_healed > 0 as has_healing, wound_reduction, sanity_reduction, wound_reduction > 0 or sanity_reduction > 0 as has_defensive,
  conditions <> '' or rerolls > 0 or wounds_healed > 0 or stress_healed > 0 or wound_reduction > 0 or sanity_reduction > 0 as improves
from f join i using (p_partkey) join c using (p_partkey)""")
def level_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effects(spark, sf_dir).select("p_partkey", statistics.level_statistics(F.col("effect")).alias("s"))
    return found.select("p_partkey", "s.*", statistics.improves(F.col("s")).alias("improves")).withColumn("conditions", F.array_join("conditions", ", "))


@query("""
with p as (select p_partkey, p_size % 6 as n, p_size % 7 as level, case when p_size % 11 = 0 then null else p_type end as text, p_brand as name from part)
select p_partkey, (n + (level between 1 and 4 and text is not null)::int)::int as n_levels, n + (level between 1 and 4 and text is not null)::int > 0 as has_levels, n + (level between 1 and 4 and text is not null)::int >= 4 as is_complete,
  case when level between 1 and 4 and text is not null then text when n > 0 then 'level ' || n end as last, name in ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#3') as has_power from p""")
def power_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels added to powers, and what is asked of them."""
    n = F.col("p_size") % 6
    levels = F.transform(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i > 0), lambda i: F.struct(i.alias("level"), F.concat(F.lit("level "), i).alias("description")))
    words = F.when(F.col("p_size") % 11 != 0, F.concat(F.lit(" \n"), "p_type", F.lit(" ")))
    grown = table(spark, sf_dir, "part").select("p_partkey", "p_brand", statistics.with_level(levels, F.col("p_size") % 7, words).alias("levels"))
    listed = F.array(*[F.lit(b) for b in ("Brand#11", "Brand#22", "Brand#33", "Brand#3")])
    return grown.select("p_partkey", F.size("levels").alias("n_levels"), statistics.has_levels(F.col("levels")).alias("has_levels"), statistics.is_complete(F.col("levels")).alias("is_complete"), F.get("levels", F.size("levels") - 1)["description"].alias("last"), statistics.has_power(listed, F.col("p_brand")).alias("has_power"))
