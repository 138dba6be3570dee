"""Benchmark decontamination as a prefix-filtered join of item windows with document words.

An item's shingles are its windows of ten consecutive words (a shorter item is one window). The words of a window
are ordered by their rarity over all documents, and the prefix that a containing document cannot do
without is the rarest word. Document words are joined with these prefix words; the place of the
word in its window then gives the only possible start, which must lie inside the document (length and
positional bounds), and the words from there are compared one by one. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import fenced, table, text_key, text_or_empty
from terrane.session import Stored

WINDOW = 10
#: Rows of the windows up to which they are sent to every task; more are shuffled with the document words.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column | str) -> Column:
    """Words of ASCII letters, digits and anything beyond ASCII, with A-Z in lower case."""
    t = text_or_empty(text)
    ascii_only = F.length(t) == F.octet_length(t)
    low = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(seq, items)``: each distinct window with the ids of its items, null among them. Only items without words give none."""
    w = fenced(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("t")), w=plain_words("t"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.where("size(w) > 0").select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("seq"))
    held = F.sort_array(F.collect_set(F.struct("item")))  # a struct, as collect_set leaves nulls out
    return each.groupBy("seq").agg(F.transform(held, lambda i: i["item"]).alias("items"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (its ``doc_id`` and ``text``) with n_words and ``hits``: verified (start from 1, length, items)."""
    windows = Stored(item_windows(items, size=size).withColumn("wid", F.xxhash64("seq")), {"n": F.count(F.lit(1)), "words": F.sum(F.size("seq"))})
    count = windows.measures["words"] or 0
    plain = docs.select("doc_id", "text", text_key("text").alias("key"))
    worded = fenced(plain.select("key", "text"), w=plain_words("text")).drop("text")
    tokens = worded.select("key", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))

    # rarity of the items' words over all documents
    vocabulary = windows.table.select(F.explode("seq").alias("word")).distinct()
    often = tokens.join(_sent(vocabulary, count), "word").groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    ranked = windows.table.select("wid", "seq", "items", F.posexplode("seq").alias("offset", "word")).join(often, "word", "left")
    rarest = F.min_by(F.struct("word", "offset"), F.struct(F.coalesce("often", F.lit(0)), "word", "offset"))
    prefix = ranked.groupBy("seq").agg(F.any_value("items").alias("items"), rarest.alias("p"), F.max("often").alias("_"))
    prefix = prefix.select("seq", "items", F.col("p.word").alias("word"), F.col("p.offset").alias("offset"))
    prefix = Stored(prefix).table

    start = F.col("pos") - F.col("offset")
    found = tokens.join(_sent(prefix, count), "word").where((start >= 0) & (start + F.size("seq") <= F.col("n")))
    found = found.groupBy("key").agg(F.collect_set(F.struct((start + 1).alias("start"), "seq", "items")).alias("found"))
    found = Stored(found).table  # so that both sides of the join are plain exchanges, and copies of one text can be split

    both = fenced(plain.join(found, "key", "left").select("doc_id", "text", "found"), w=plain_words("text"))
    real = F.filter(F.coalesce("found", F.array().cast(dict(found.dtypes)["found"])), lambda c: F.slice("w", c["start"], F.size(c["seq"])) == c["seq"])
    hits = F.sort_array(F.transform(real, lambda c: F.struct(c["start"].alias("start"), F.size(c["seq"]).alias("len"), c["items"].alias("items"))))
    return fenced(both, n_words=F.size("w").cast("long"), hits=hits).select("doc_id", "text", "n_words", "hits")


def covered_words() -> Column:
    """Words inside at least one of ``hits``, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(1).alias("next"))
    end = lambda h: h["start"] + h["len"]
    return F.aggregate("hits", zero, lambda a, h: F.struct(
        (a["sum"] + F.greatest(F.lit(0), end(h) - F.greatest(a["next"], h["start"]))).alias("sum"),
        F.greatest(a["next"], end(h)).alias("next")), lambda a: a["sum"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; equal rows give equal results; only doc_id and text of
    ``docs`` are read. A window of an item occurs where its words follow each other in a document. Items with a null
    item_id are searched like all others; as in the SQL, null is one id in n_items and has no part in items_sha256.
    """
    df = contaminated_spans(docs, items, size)
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    df = fenced(df.drop("text"), n_hit=covered_words(), ids=ids)
    return df.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
                     F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    return contaminated_spans(packed, items, size).where("size(hits) = 0").select("doc_id.*")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS len, array_to_string(w[k:k + 9], ' ') AS seq
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hit AS (
  SELECT doc_id, p, l.len, item FROM place, (SELECT DISTINCT len FROM win) l, win
  WHERE p + l.len - 1 <= len(w) AND win.len = l.len AND win.seq = array_to_string(w[p:p + l.len - 1], ' ')
), covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + len)) AS q FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN item t USING (doc_id)
"""
