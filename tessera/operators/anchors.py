"""Sections of documents that begin at names out of a table, and the levels that a section's text lists.

Names stand at whole words, in any case. A section goes from its name to the next name of the table, whichever it is, or to the document's end.
Null texts and names have none; of names that begin at one word the longest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import let
from tessera.operators.intervals import overlap_join

#: Rows of a table of names that may be broadcast, and first words of names that may be constants of the plan.
FEW_NAMES, FEW_FIRST = 100_000, 1_000


def _words(text: Column) -> Column:
    """(line, word) of a text's words, which spaces and line feeds set apart."""
    return F.flatten(F.transform(F.split(text, "\n", -1), lambda line, i: F.transform(F.filter(F.split(line, " ", -1), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("word")))))


def _plain_words(text: Column) -> Column:
    """A text's words alone."""
    return F.filter(F.split(F.translate(text, "\n", " "), " ", -1), lambda w: w != "")


def anchors(rows: DataFrame, identifier: str, names: DataFrame) -> DataFrame:
    """(id, pos, size, name) of each place where a name stands: its first word's number in the text, and how many words it has.

    Words meet names by their first word, so no text is searched for every name.
    """
    known = names.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    known = known.withColumns({"_parts": F.split("name", " +"), "size": F.size(F.split("name", " +"))})
    known = known.select(F.array_join("_parts", " ").alias("name"), "size", F.get("_parts", F.lit(0)).alias("_first"))
    few = known.limit(FEW_NAMES + 1).count() <= FEW_NAMES
    longest = known.agg(F.max("size")).first()[0] or 1
    firsts = [r["_first"] for r in known.select("_first").distinct().limit(FEW_FIRST + 1).collect()]

    def following(words: Column) -> Column:
        at = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("_first")))
        if len(firsts) <= FEW_FIRST:  # only words that begin a name leave the row
            at = F.filter(at, lambda p: p["_first"].isin(firsts))
        return F.transform(at, lambda p: F.struct(p["pos"].alias("pos"), p["_first"].alias("_first"), F.slice(words, p["pos"] + 1, longest).alias("_next")))

    listed = rows.where("text is not null").select(F.col(identifier).alias("id"), F.explode(let(_plain_words(F.lower("text")), following)).alias("_at"))
    places = listed.select("id", "_at.pos", "_at._first", "_at._next")
    met = places.join(F.broadcast(known) if few else known, "_first").where(F.array_join(F.slice("_next", 1, F.col("size")), " ") == F.col("name"))
    best = F.max_by(F.struct("size", "name"), F.struct("size", "name"))
    return met.groupBy("id", "pos").agg(best.alias("_best")).select("id", "pos", "_best.size", "_best.name")


def sections(rows: DataFrame, identifier: str, names: DataFrame) -> DataFrame:
    """(id, name, occurrence, start, end): words from each name up to the next name; occurrence counts a name's sections in a document from 1."""
    sizes = rows.where("text is not null").select(F.col(identifier).alias("id"), F.size(_plain_words(F.col("text"))).alias("_total"))
    order = Window.partitionBy("id").orderBy("pos")
    # a name within a name, such as the second word of two, begins no section
    found = anchors(rows, identifier, names).withColumn("_before", F.max(F.col("pos") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.where("_before is null or pos >= _before").join(sizes, "id")
    ends = F.coalesce(F.lead("pos").over(order), F.col("_total"))
    number = F.row_number().over(Window.partitionBy("id", "name").orderBy("pos"))
    return found.select("id", "name", number.alias("occurrence"), F.col("pos").alias("start"), ends.alias("end"))


def line_ranges(rows: DataFrame, identifier: str) -> DataFrame:
    """(id, line, first, last): the half-open range of words of every line that has some."""
    of_word = F.flatten(F.transform(F.split("text", "\n", -1), lambda line, i: F.array_repeat(i, F.size(F.filter(F.split(line, " ", -1), lambda w: w != "")))))

    def ranges(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("first"))), lambda s: (s["first"] == 0) | (F.get(lines, s["first"] - 1) != s["line"]))
        return let(starts, lambda own: F.transform(own, lambda s, i: F.struct(s["line"].alias("line"), s["first"].alias("first"), F.coalesce(F.get(own, i + 1)["first"], F.size(lines)).alias("last"))))

    found = rows.where("text is not null").select(F.col(identifier).alias("id"), F.inline(let(of_word, ranges)))
    return found.groupBy("id", "line").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def lines_of_sections(rows: DataFrame, identifier: str, names: DataFrame) -> DataFrame:
    """(id, name, occurrence, line, words): every line that a section reaches into, with how many of its words are the section's."""
    met = overlap_join(sections(rows, identifier, names), line_ranges(rows, identifier), ["id"], ("start", "end"), ("first", "last"))
    return met.select("id", "name", "occurrence", "line", (F.least("end", "last") - F.greatest("start", "first")).alias("words"))


def section_texts(rows: DataFrame, identifier: str, names: DataFrame, first_only: bool = True) -> DataFrame:
    """(id, name, occurrence, start, end, text): the words of each section, of a name's first one in a document alone unless told otherwise, with the text's line feeds."""
    found = sections(rows, identifier, names)
    found = found.where("occurrence = 1") if first_only else found
    joined = found.join(rows.select(F.col(identifier).alias("id"), _words(F.col("text")).alias("_words")), "id")
    own = F.slice("_words", F.col("start") + 1, F.col("end") - F.col("start"))
    before = lambda i: F.get(F.col("_own"), i - 1)["line"]
    spaced = F.transform("_own", lambda w, i: F.concat(F.when(i == 0, "").when(w["line"] != before(i), "\n").otherwise(" "), w["word"]))
    return joined.withColumn("_own", own).select("id", "name", "occurrence", "start", "end", F.array_join(spaced, "").alias("text"))


def numbered_levels(text: Column, least: int = 10) -> Column:
    """Level number (1 to 4) -> text of what follows "Level n" or a number at a line's start, up to the next one.

    White space is one space, a page number at the end goes, and what begins with "Appendix" or has ``least`` characters or fewer, before or after that, is left out; of two texts of one
    number the later counts.
    """
    mark = r"(?:level|^)\s*([1234])[:\-.]?\s*"
    pattern = F.lit(rf"(?ims){mark}(.*?)(?=(?:level|^)\s*[1234]|\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("level"), F.regexp_extract_all(text, pattern, 2).alias("text"))
    plain = F.transform(pairs, lambda p: F.struct(p["level"].cast("int").alias("level"), F.regexp_replace(F.regexp_replace(p["text"], r"^\s+|\s+$", ""), r"\s+", " ").alias("text")))
    usable = F.filter(plain, lambda p: (F.length(p["text"]) > least) & ~F.startswith(p["text"], F.lit("Appendix")))
    cut = F.transform(usable, lambda p: F.struct(p["level"].alias("level"), F.regexp_replace(F.regexp_replace(p["text"], r"\d+\s*\z", ""), r"\s+\z", "").alias("text")))
    kept = F.filter(cut, lambda p: F.length(p["text"]) > least)
    last = lambda n: F.try_element_at(F.filter(kept, lambda p: p["level"] == n), F.lit(-1))
    each = F.array(*(last(n) for n in (1, 2, 3, 4)))
    return F.when(text.isNotNull(), F.map_from_entries(F.filter(each, lambda p: p.isNotNull())))
