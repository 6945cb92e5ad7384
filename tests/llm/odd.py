"""Rows that operators must bear: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the quick brown fox jumps over the lazy dog and runs to the river with all of its friends from the north"
GERMAN = "der schnelle braune fuchs und die katze laufen nicht über das feld mit den freunden von der schule zu dem fluss"


def rows():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(20000)] + ["the", "of"] * 2000
    long = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    out = [
        (1, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "de", None),
        (None, PLAIN + " far away", "en", "a"), (None, None, None, None), (6, GERMAN, "de", "b"), (7, GERMAN + " heute", "de", "c"), (8, "!!! 123 ...", None, "c"),
        (9, long, "en", "c"), (2**60 + 1, "ein wort", "de", "d"), (10, "word", "en", "d"), (11, "é ü 漢字 \U0001f600 ok", None, "d"), (-5, PLAIN.upper(), "en", None),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


def odd(spark, *clashing: str):
    df = spark.createDataFrame(rows(), SCHEMA)
    for c in clashing:
        df = df.withColumn(c, F.lit("theirs"))
    return df.repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows_, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows_), key=repr)
