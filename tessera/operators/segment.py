"""Lines of texts with their place, sections, neighbouring lines and nearest headings.

Every window is within one document, so rows of a document meet in a task; documents are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(rows: DataFrame, identifier: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """(id, pos, line), pos from 0; null texts have none."""
    return rows.select(identifier, F.posexplode(F.split(text, separator)).alias("pos", "line"))


def sections(rows: DataFrame, identifier: str, heading: Column, order: str = "pos") -> DataFrame:
    """Rows with ``section``: how many headings there are up to and with the row; 0 before the first."""
    window = Window.partitionBy(identifier).orderBy(order)
    return rows.withColumn("section", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(window))


def nearest_before(rows: DataFrame, identifier: str, value: Column, order: str = "pos", reach: int | None = None) -> Column:
    """The latest non-null value before each row, at most ``reach`` rows back if given."""
    window = Window.partitionBy(identifier).orderBy(order).rowsBetween(-reach if reach else Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(window)


def count_after(identifier: str, flag: Column, order: str = "pos", reach: int = 3) -> Column:
    """How many of the next ``reach`` rows have the flag."""
    window = Window.partitionBy(identifier).orderBy(order).rowsBetween(1, reach)
    return F.coalesce(F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(window), F.lit(0))


def adjacent_phrase(identifier: str, line: str, longest: int, order: str = "pos") -> Column:
    """A line and the next one, joined, where both have at most ``longest`` characters and are not empty."""
    after = F.lead(line).over(Window.partitionBy(identifier).orderBy(order))
    short = lambda c: (F.length(F.trim(c)) > 0) & (F.length(F.trim(c)) <= longest)
    return F.when(short(F.col(line)) & short(after), F.concat(F.trim(line), F.lit(" "), F.trim(after)))


def around(rows: DataFrame, identifier: str, hit: Column, before: int = 5, after: int = 20, order: str = "pos") -> DataFrame:
    """The rows from ``before`` before each document's first hit to ``after - 1`` after it."""
    first = F.min(F.when(hit, F.col(order))).over(Window.partitionBy(identifier))
    return rows.withColumn("_first", first).where((F.col(order) >= F.col("_first") - before) & (F.col(order) < F.col("_first") + after)).drop("_first")


def levels(rows: DataFrame, identifier: str, most: int = 4, least_words: int = 3) -> DataFrame:
    """(id, level, text) of each document's ability levels.

    A line that begins with a number and a mark, or holds "instead", closes the level before it and opens one; lines before
    the first belong to none. Levels of under ``least_words`` words and repeats of a text are dropped, and
    at most ``most`` are kept. Lines are folded in order inside the JVM.
    """
    mark = r"^(\d+[.:)])(?: |$)"
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    state = "struct<open:string,found:array<string>>"
    start = F.struct(F.lit(None), F.array()).cast(state)

    def closed(s: Column) -> Column:
        words = F.size(F.filter(F.split(s["open"], r"\s+"), lambda w: w != ""))
        new = s["open"].isNotNull() & (words >= least_words) & ~F.array_contains(s["found"], F.coalesce(s["open"], F.lit("")))
        return F.when(new, F.concat(s["found"], F.array(s["open"]))).otherwise(s["found"])

    def step(s: Column, line: Column) -> Column:
        opens = line.rlike(mark) | F.contains(F.lower(line), F.lit("instead"))
        begun = F.struct(F.regexp_replace(line, mark, "").alias("open"), closed(s).alias("found")).cast(state)
        longer = F.struct(F.concat(s["open"], F.lit(" "), line).alias("open"), s["found"].alias("found")).cast(state)
        return F.when(opens, begun).when(s["open"].isNotNull() & (line != ""), longer).otherwise(s.cast(state))

    found = F.slice(F.aggregate(lines, start, step, closed), 1, most)
    typed = rows.select(F.col(identifier).cast("long").alias("id"), "text").where("text is not null and id is not null")
    return typed.select("id", F.posexplode(found).alias("level", "text")).select("id", (F.col("level") + 1).alias("level"), "text")
