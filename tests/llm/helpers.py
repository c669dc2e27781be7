"""Fixtures that the tests of this folder share."""

import random

WORDS = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which".split()


def edge_documents():
    """Rows with everything that a table may hold: nulls, empties, repeats, odd spaces, long texts, other scripts."""
    r = random.Random(5)
    prose = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)) for n in (3, 60, 130, 400)]
    rows = [
        (1, prose[3], "en", "a"),
        (2, prose[3], "en", "a"),
        (3, prose[3][:900] + " changed " + prose[3][900:], "en", "b"),
        (4, prose[2] + "\n" + prose[1], None, "b"),
        (5, prose[1] + " tail words here\n" + prose[2].upper(), "en", None),
        (6, None, "en", "c"),
        (7, "", "de", "c"),
        (8, " \n\t ", "de", "c"),
        (9, "12345 !!! ###", None, "c"),
        (10, "über straße größe café naïve", "de", "c"),
        (11, "日本語 のテキスト　です", "ja", "d"),
        (12, "a", "en", "d"),
        (None, prose[3], "en", "d"),
        (13, "word " * 3000, "en", "d"),
        (14, prose[0] + "\x1c\x85 end <|endoftext|> it's we're", "en", "d"),
        (12, "a", "en", "d"),
        (12, "another text of the same id with some more words", "en", "d"),
    ]
    return [(*row, len(row[1] or "")) for row in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "spans int, start int, fp int, key string, score double, rank int, length int, bigrams int, _id int, id int"


def documents(spark, rows=None, clash=False):
    df = spark.createDataFrame(edge_documents() if rows is None else rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in CLASH.split(", ")])
    return df


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
