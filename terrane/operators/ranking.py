"""Global ranks and order statistics without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 4096


def ranked_by_bucket(df: DataFrame, bucket: Column, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """0-based rank over (bucket, order), where ``bucket`` is monotone in the order wanted.

    Rows are ranked inside their bucket; offsets come from the (bounded) table of bucket sizes.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inner = W.partitionBy("_bucket").orderBy(*order)
    ranked = b.withColumn("_inner", F.row_number().over(inner) - 1).join(offsets, "_bucket")
    return ranked.withColumn(out, F.col("_offset") + F.col("_inner")).drop("_bucket", "_inner", "_offset")


def hash_rank(df: DataFrame, key: Column | str, seed: int | str, out: str = "rank", n: int | None = None) -> DataFrame:
    """0-based rank in a seeded pseudo-random order; the key must be unique.

    Buckets are hash prefixes, long enough to hold about a million rows each when ``n`` is given.
    """
    key = F.col(key) if isinstance(key, str) else key
    digits = max(3, ceil(log((n or 1) / 1e6 + 1, 16)))
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))))
    return ranked_by_bucket(hashed, F.substring("_h", 1, digits), ["_h"], out).drop("_h")


def index_rank(df: DataFrame, idx: str, n: int, out: str = "rank") -> DataFrame:
    """0-based rank by an integer index known to lie in [0, n)."""
    width = max(1, -(-n // BUCKETS))
    return ranked_by_bucket(df, F.floor(F.col(idx) / width), [idx], out)


def hash_uniform(key: Column | str, seed: int | str) -> Column:
    """Deterministic uniform number in [0, 1) from the first 32 bits of an md5."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def order_statistics(df: DataFrame, y: str, ranks: Sequence[int], bins: int = 1024, final: int = 4096) -> list[float]:
    """Exact values at 0-based ranks: histograms narrow the range until few values are left.

    All ranks share each histogram, and the small bins that hold them are fetched together. Infinite
    values are counted, not binned; NaN comes last, as in Spark's own order.
    """
    given = df.select(F.col(y).cast("double").alias("v")).where("v is not null")
    infinite = F.lit(float("inf"))
    finite = (F.abs("v") < infinite) & ~F.isnan("v")
    values = given.where(finite)
    low, high, inside, under, over = given.agg(
        F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v"))), F.count_if(finite), F.count_if(F.col("v") == -infinite), F.count_if(F.col("v") == infinite),
    ).first()
    found: dict[int, float] = {}
    small: list[tuple[float, float, dict[int, int]]] = []
    wanted = {}
    for r in set(ranks):
        if r < under:
            found[r] = float("-inf")
        elif r < under + inside:
            wanted[r] = r - under
        else:
            found[r] = float("inf") if r < under + inside + over else float("nan")
    ranges = [(low, high, wanted)] if wanted else []
    while ranges:
        low, high, wanted = ranges.pop()
        if low == high:
            found |= {r: low for r in wanted}
            continue
        which = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        rows = values.where(F.col("v").between(low, high)).groupBy(which.alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        ).orderBy("bin").collect()
        before = 0
        for row in rows:
            inside = {r: k - before for r, k in wanted.items() if before <= k < before + row.n}
            before += row.n
            if inside:
                (small if row.n <= final else ranges).append((row.lo, row.hi, inside))
    if small:
        test = F.lit(False)
        for lo, hi, _ in small:
            test = test | F.col("v").between(lo, hi)
        kept = sorted(r.v for r in values.where(test).collect())
        for lo, hi, inside in small:
            own = [v for v in kept if lo <= v <= hi]
            found |= {r: own[k] for r, k in inside.items()}
    return [found[r] for r in ranks]


def percentiles(df: DataFrame, y: str, qs: Sequence[float]) -> list[float]:
    """Linear-interpolation percentiles (q in 0..100)."""
    n = df.where(F.col(y).isNotNull()).count()
    positions = [q / 100.0 * (n - 1) for q in qs]
    ranks = sorted({k for p in positions for k in (int(p), min(int(p) + 1, n - 1))})
    at = dict(zip(ranks, order_statistics(df, y, ranks)))
    between = lambda a, b, t: a if t == 0 or a == b else a + t * (b - a)  # not inf - inf
    return [between(at[int(p)], at[min(int(p) + 1, n - 1)], p - int(p)) for p in positions]


def percentile(df: DataFrame, y: str, q: float) -> float:
    return percentiles(df, y, [q])[0]
