"""Licence scans: every line, paragraph and whole text against licence templates, by Dice over word bigrams (op1).

Only DataFrame functions: texts are normalised (lower case, anything but a-z, 0-9 to one space), cut into units (each line, each paragraph of several
lines where blank lines part the text, so that a wrapped notice inside a longer text is one unit, and the whole text if it has several lines) and into sets of word bigrams. A unit of n bigrams can only reach a coefficient t with templates of
n * t / (2 - t) to n * (2 - t) / t bigrams, so templates are listed by the unit sizes that they allow and joined on the size. That list grows with the
square of a template's length; it is broadcast while it holds at most ``BROADCAST_BIGRAMS``, and then nothing is shuffled. Each unit keeps its best template.
A match shares at least t / (2 - t) of its template's bigrams, so a text can be passed over if it holds none of a few
``anchors``, words that stand in more of each template's bigrams than a match can do without.

A run is what finds a notice of several paragraphs, one with no blank line around it, or one in comment marks with code below. For each
template of ``LONG`` words or more a line counts twice its bigrams that the template has, less ``least`` times its bigrams. Dice reaches ``least`` just where that sum
over a unit is ``least`` times the template's bigrams, so one pass that starts again where the sum is used up, and ends at its peak, marks the lines to look at. Blank
lines count nothing, and a line's first bigram begins with the last word before it. The pass is made twice, the second time starting again at each line
with the template's first bigram too, so that copies near each other are found one by one as well as together. Only texts with an anchor of that template are passed over, so runs cost
little where there are no notices. Templates stand in the plan once more for it.

Defined results: null and empty texts, and units of fewer than two words, match nothing; of equally good templates the first in
the table wins; very long texts and lines are read whole; repeated rows each give their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scoring import let

#: Wording of public licence notices and of short licences, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


#: What parts paragraphs of normalised text.
BREAK = "\n( ?\n)+"
#: Bigrams in the list of templates by size up to which it is broadcast.
BROADCAST_BIGRAMS = 4_000_000
#: Templates of so many words are looked for in runs of lines too; shorter ones are sentences that stand in a line or a paragraph.
LONG = 24


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def _bigrams(unit: Column) -> Column:
    """Distinct word bigrams of normalised text; empty for fewer than two words."""
    return _pairs(F.split(F.trim(unit), " "))


def _pairs(words: Column) -> Column:
    less = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, less), F.slice(words, 2, less), lambda a, b: F.concat(a, F.lit(" "), b)))


def anchors(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every text that reaches ``least`` with some template holds one at least.

    Of each template the words, those already taken first and long ones before short ones, that cover most of its
    bigrams, until fewer bigrams are left than a match has to share.
    """
    taken: list[str] = []
    for _, wording in templates:
        words = re.sub("[^a-z0-9]+", " ", wording.lower()).split()
        left = set(zip(words, words[1:], strict=False))
        shared = len(left) * least / (2 - least) - 1e-9
        while left and len(left) >= shared:
            gain = {w: sum(w in pair for pair in left) for w in words}
            best = max(gain, key=lambda w: (gain[w] > 0 and w in taken, min(len(w), 7) if gain[w] else 0, gain[w], w))
            left = {pair for pair in left if best not in pair}
            taken += [best] * (best not in taken)
    return taken


def _by_size(docs: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(size, candidates): the templates that a unit of ``size`` bigrams can reach, in order."""
    rows = docs.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(templates)], "place int, licence string, text string")
    known = rows.select("place", "licence", _bigrams(F.replace(_normalised(F.col("text")), F.lit("\n"), F.lit(" "))).alias("bigrams")).where(F.size("bigrams") > 0)
    low, high = F.ceil(F.size("bigrams") * least / (2 - least) - 1e-9), F.floor(F.size("bigrams") * (2 - least) / least + 1e-9)
    allowed = known.select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"), "place", "licence", "bigrams")
    return allowed.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("place", "licence", "bigrams"))).alias("candidates"))


def _listed_bigrams(templates: list[tuple[str, str]], least: float) -> float:
    """At most so many bigrams are in the list of templates by size."""
    return sum(n * n * ((2 - least) / least - least / (2 - least)) + n for n in (len(text.split()) for _, text in templates))


def _plain_words(wording: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", wording.lower()).split()


def _long(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [t for t in templates if len(_plain_words(t[1])) >= LONG]


def _peaks(gains: Column, need: Column) -> Column:
    """array<struct<first, last>> (indexes) of the stretches that begin where a running sum, never under 0, leaves 0 or at a line that ``opens``, and end at its first peak, if that is ``need``."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    fresh = lambda begin, found: F.struct(F.lit(0).cast("long").alias("total"), begin.cast("int").alias("begin"), F.lit(0).cast("long").alias("best"), F.lit(-1).alias("last"), found.alias("found"))
    closed = lambda s: F.when((s["last"] >= 0) & (s["best"] >= need), F.array_append(s["found"], F.struct(s["begin"].alias("first"), s["last"].alias("last")))).otherwise(s["found"])

    def step(s: Column, x: Column) -> Column:
        return let(F.when(x["opens"], fresh(x["k"], closed(s))).otherwise(s), lambda s: added(s, x))

    def added(s: Column, x: Column) -> Column:
        total = s["total"] + x["gain"]
        on = F.struct(total.alias("total"), s["begin"].alias("begin"), F.greatest(total, s["best"]).alias("best"), F.when(total > s["best"], x["k"]).otherwise(s["last"]).alias("last"), s["found"].alias("found"))
        return F.when(total <= 0, fresh(x["k"] + 1, closed(s))).otherwise(on)

    return F.aggregate(gains, fresh(F.lit(0), none), step, closed)


def _runs(text: Column, templates: list[tuple[str, str]], least: float) -> Column:
    """array<struct<at, last, unit>> of the runs of several lines of normalised text that may hold a long template."""
    long, thousandths = _long(templates), round(1000 * least)
    nothing = F.array().cast("array<struct<at:int,last:int,unit:string>>")
    if not long:
        return nothing
    # a doc is looked through for a template only if it holds one of that template's anchors
    owners: dict[str, list[int]] = {}
    for place, t in enumerate(long):
        for word in anchors([t], least):
            owners.setdefault(word, []).append(place)
    # bigrams in order of first appearance
    shaped = [list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) for w in (_plain_words(t[1]) for t in long)]
    known = F.from_json(F.lit(json.dumps(shaped)), "array<array<string>>")
    words = F.from_json(F.lit(json.dumps([{"word": w, "places": p} for w, p in owners.items()])), "array<struct<word:string,places:array<int>>>")
    places = F.array_distinct(F.flatten(F.transform(F.filter(words, lambda a: F.contains(text, a["word"])), lambda a: a["places"])))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.split(F.trim(x), " ").alias("words"))), lambda x: F.get(x["words"], F.lit(0)) != "")
    paired = lambda rows: F.transform(rows, lambda x, k: F.struct(x["at"].alias("at"), x["words"].alias("words"), _pairs(F.when(k > 0, F.concat(F.slice(F.get(rows, k - 1)["words"], -1, 1), x["words"])).otherwise(x["words"])).alias("pairs")))

    def of_template(rows: Column, shape: Column) -> Column:
        opens = lambda x: F.array_contains(x["pairs"], F.get(shape, F.lit(0)))
        gains = F.transform(rows, lambda x, k: F.struct(k.alias("k"), (2000 * F.size(F.array_intersect(x["pairs"], shape)) - thousandths * F.size(x["pairs"])).cast("long").alias("gain"), opens(x).alias("opens")))
        need = F.floor(F.size(shape) * thousandths / 2)
        return let(gains, lambda g: F.concat(_peaks(F.transform(g, lambda x: x.withField("opens", F.lit(False))), need), _peaks(g, need)))

    def units(rows: Column) -> Column:
        spans = F.array_distinct(F.flatten(F.transform(places, lambda p: let(F.get(known, p), lambda shape: of_template(rows, shape)))))
        several = F.filter(spans, lambda s: s["last"] > s["first"])
        unit = lambda s: F.array_join(F.flatten(F.transform(F.slice(rows, s["first"] + 1, s["last"] - s["first"] + 1), lambda x: x["words"])), " ")
        return F.transform(several, lambda s: F.struct(F.get(rows, s["first"])["at"].alias("at"), F.get(rows, s["last"])["at"].alias("last"), unit(s).alias("unit")))

    return F.when(F.size(places) > 0, let(lines, lambda rows: let(paired(rows), units))).otherwise(nothing)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, line, last_line, licence and dice of every unit whose best template reaches ``least``.

    ``line`` counts from 0; it is -1 for the whole text and -2 - n for paragraph n (from 0), whose ``last_line`` is null. A run of lines has its
    first and last line; it has a row of its own where a paragraph or the whole text holds the notice too.
    """
    templates = TEMPLATES if templates is None else templates
    if not math.isfinite(least) or not 0 < least <= 1:
        raise ValueError("least is over 0 and at most 1")
    low = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).where("text is not null")
    some = reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in anchors(templates, least)], F.lit(False))
    text = low.where(some).select("doc_id", _normalised(F.col("text")).alias("text"))
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.regexp_replace("text", " ?\n[ \n]*", " "))).otherwise(F.array())
    parts = F.split("text", BREAK)
    # a lone paragraph is the whole text
    several = F.when(F.size(parts) > 1, F.transform(parts, lambda p, i: F.struct((-2 - i).alias("at"), F.lit(None).cast("int").alias("last"), F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, " ?\n ?", " ")).alias("unit"))))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), i.alias("last"), x.alias("unit")))
    wholes = F.transform(whole, lambda x, i: F.struct((i - 1).alias("at"), F.lit(None).cast("int").alias("last"), x.alias("unit")))
    none = F.array().cast("array<struct<at:int,last:int,unit:string>>")
    units = text.select("doc_id", F.inline(F.concat(wholes, F.coalesce(several, none), lines, _runs(F.col("text"), templates, least))).alias("line", "last_line", "unit")).where("unit is not null")
    words = units.select("doc_id", "line", "last_line", F.split(F.trim("unit"), " ").alias("words"))
    sized = words.select("doc_id", "line", "last_line", _pairs(F.col("words")).alias("bigrams"))
    known = _by_size(docs, templates, least)
    known = F.broadcast(known) if _listed_bigrams(templates, least) <= BROADCAST_BIGRAMS else known
    met = sized.join(known, F.size("bigrams") == F.col("size"))
    dice = F.transform("candidates", lambda c: F.struct((F.lit(2.0) * F.size(F.array_intersect(c["bigrams"], F.col("bigrams"))) / (F.size(c["bigrams"]) + F.col("size"))).alias("dice"), (-c["place"]).alias("order"), c["licence"].alias("licence")))
    best = met.select("doc_id", "line", "last_line", F.array_max(dice).alias("best"))
    return best.where(F.col("best.dice") >= least).select("doc_id", F.col("line").cast("int"), F.col("last_line").cast("int"), F.col("best.licence").alias("licence"), F.col("best.dice").alias("dice"))


def oracle(least: float = 0.8) -> str:
    """DuckDB SQL for ``scan`` with the default templates on the table ``documents``."""
    rows = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
    clean = "regexp_replace(lower({}), '[^a-z0-9\\n]+', ' ', 'g')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    thousandths = round(1000 * least)
    holds = " or ".join(f"contains(text, '{w}')" for w in anchors(_long(TEMPLATES), least))
    return f"""
with templates(place, licence, text) as (values {rows}),
t as (select place, licence, len(w) as n, w[1] || ' ' || w[2] as opening, {pairs} as b from (select place, licence, list_filter(string_split(trim({clean.format('text')}), ' '), lambda x: x <> '') as w from templates)),
d as (select doc_id, {clean.format('text')} as text from documents where text is not null),
nb as (select doc_id, nr, ws, row_number() over (partition by doc_id order by nr) as k from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as nr, string_split(trim(unnest(string_split(text, chr(10)))), ' ') as ws from d where {holds}) where ws[1] <> ''),
pr as (select doc_id, k, {pairs} as b from (select doc_id, k, case when k > 1 then list_prepend((lag(ws) over (partition by doc_id order by k))[-1], ws) else ws end as w from nb)),
g as (select doc_id, place, way, k, len(t.b) as size, 2000 * len(list_intersect(pr.b, t.b)) - {thousandths} * len(pr.b) as gain, way * list_contains(pr.b, opening)::int as opens from pr join t on t.n >= {LONG}, (values (0), (1)) ways(way)),
o as (select *, sum(opens) over (partition by doc_id, place, way order by k) as part from g),
c as (select *, sum(gain) over (partition by doc_id, place, way, part order by k) as upto from o),
e as (select *, upto <= least(0, coalesce(min(upto) over (partition by doc_id, place, way, part order by k rows between unbounded preceding and 1 preceding), 0)) as used from c),
f as (select *, sum(used::int) over (partition by doc_id, place, way, part order by k) as stretch from e),
h as (select doc_id, min(k) as first, arg_min(k, (-upto, k)) as last from f where not used group by doc_id, place, way, part, stretch, size having max(upto) - arg_min(upto - gain, k) >= floor(size * {thousandths} / 2.0)),
r as (select distinct doc_id, first, last from h where last > first),
ru as (select r.doc_id, (min(nr))::int as line, (max(nr))::int as last_line, flatten(list(ws order by k)) as w from r join nb on r.doc_id = nb.doc_id and k between first and last group by r.doc_id, first, last),
u as (select doc_id, -1 as line, null::int as last_line, regexp_replace(text, ' ?\\n[ \\n]*', ' ', 'g') as unit from d where contains(text, chr(10))
      union all select doc_id, (-1 - i)::int, null, regexp_replace(p, ' ?\\n ?', ' ', 'g') from (select doc_id, unnest(string_split_regex(text, '\\n( ?\\n)+')) as p, generate_subscripts(string_split_regex(text, '\\n( ?\\n)+'), 1) as i from d where regexp_matches(text, '\\n ?\\n')) where contains(p, chr(10))
      union all select doc_id, i, i, p from (select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as i, unnest(string_split(text, chr(10))) as p from d)),
s as (select doc_id, line, last_line, {pairs} as b from (select doc_id, line, last_line, string_split(trim(unit), ' ') as w from u union all select doc_id, line, last_line, w from ru)),
m as (select doc_id, line, last_line, licence, place, 2.0::double * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) as dice
      from s join t on len(s.b) between ceil(len(t.b) * {least} / (2 - {least}) - 1e-9) and floor(len(t.b) * (2 - {least}) / {least} + 1e-9))
select doc_id, line, last_line, licence, dice from m where dice >= {least} qualify row_number() over (partition by doc_id, line, last_line order by dice desc, place) = 1"""
