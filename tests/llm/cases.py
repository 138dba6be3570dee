"""Awkward documents: nulls, empty and long texts, repeated rows, copies, and columns with names the operators use."""

import random

from pyspark.sql import functions as F

CLASHES = ("key", "row", "cls", "_w", "unit", "spans", "size", "shard", "n_words", "kept", "hits", "rank", "slot", "_bucket", "found", "w", "start", "part")


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    words = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(words)


def changed(text, at):
    words = text.split(" ")
    words[at] = "changed"
    return " ".join(words)


BASE = prose(400, 1)
LONG = prose(30_000, 2, 10**6)
ROWS = [
    (1, None), (2, ""), (3, " \n\t \x0b"), (4, "one two three"), (5, "one two three"),
    (10, BASE), (11, BASE), (11, BASE), (12, changed(BASE, 0)), (13, changed(BASE, 399)), (14, changed(changed(BASE, 100), 300)),
    (20, LONG), (21, changed(LONG, 15_000)), (22, prose(200, 3) + " " + " ".join(BASE.split(" ")[100:180]) + " " + prose(200, 4)),
    (30, prose(120, 5)), (31, prose(120, 6)), (32, "é ß 日本 \U0001f600 " + prose(60, 7)), (33, "a " * 100), (34, "x y z " * 40),
    (None, prose(80, 8)), (None, None), (None, prose(80, 8)),
]


def documents(spark, rows=ROWS):
    """documents with its columns and more whose names clash."""
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]).repartition(3)


def no_documents(spark):
    return documents(spark).where("doc_id = -5")
