"""Steps that several corpus operators share: words, ranks over any number of rows, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: What separates words everywhere in this folder: ASCII blanks, as bytes.split() takes them.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once a row, even where a lambda above refers to them per element.

    The optimizer copies a projected expression into the lambdas that use it; it does not look into
    the output of a generator.
    """
    names = list(columns)
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_fenced")
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, packed).select(*kept, *[F.col("_fenced")[n].alias(n) for n in names])


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column | str) -> Column:
    """Array of the words of a text; none for null."""
    return F.filter(F.split(text_or_empty(text), BLANKS), lambda w: w != "")


def text_key(text: Column | str) -> Column:
    """16 bytes that stand for a text; null stays null."""
    return F.unhex(F.md5(text))


def in_arrow(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(batches, schema)


def running_total(df: DataFrame, bucket: Column, order: Sequence[Column | str], amount: Column, out: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sum of ``amount`` in the order (bucket, order), for each value of ``by``.

    Rows are summed inside their bucket; what lies before a bucket comes from the small table of bucket
    sums. ``bucket`` must spread the rows of every ``by`` evenly, so no task sorts more than a bucket.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket).withColumn("_amount", amount.cast("long"))
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_amount").alias("_sum"))
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    return (rows.join(starts, [*by, "_bucket"]).withColumn(out, F.col("_start") + F.col("_within"))
            .drop("_bucket", "_amount", "_within", "_start"))


def buckets_for(rows: int, each: int = 4000) -> int:
    """How many hash buckets hold ``rows`` rows with about ``each`` rows in one."""
    return max(16, ceil(rows / each))


def hash_bucket(n: int, *columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("long")


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """16 bytes for a (doc_id, text) pair, nulls included; rows equal in both share it."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.md5(text), F.lit("~")))))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) for each run of equal values of an integer column, across batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(cuts, cuts[1:]):
            if held and k[s] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(k[s])
            held.append(b.slice(s, e - s))
    if held:
        yield current, pa.Table.from_batches(held)
