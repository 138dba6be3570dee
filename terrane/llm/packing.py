"""Packing by cutting-stock column generation.

A document's ids are cut into full sequences and a rest; the rests are packed. Only the histogram of rest
lengths (of each length up to SHORT, above it of at most 4096 / GRAIN classes, lengths rounded up) reaches the driver.
Short rests are first bundled by their exact lengths, largest first, and bundles are rests like the others; so
rounding costs at most GRAIN - 1 tokens for each SHORT + 1, whatever the lengths. There a linear program over
patterns (how many rests of each class share a sequence) is solved by column generation: the simplex basis gives
prices, a knapsack over the sequence length finds the pattern that pays most, until none does or
the bound is near. Pattern counts are rounded down, what is left is packed largest first, and documents, ranked
inside their class, are dealt to the patterns by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from terrane.llm.common import buckets_for, hash_bucket, running_total, table
from terrane.llm.tokens import encoder
from terrane.session import Stored

LENGTH = 4096
GRAIN = 8
SHORT, BUNDLE = 128, 256  # rests up to SHORT tokens are bundled into BUNDLE
END_ID = 2
GAP = 0.0005  # the program stops this near to its lower bound


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every document; a null text is empty."""
    end = np.array([end_id], "<u4").tobytes()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for b in rows:
            at, start, size, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = tokens.encode(text or "") + end
                n = len(ids) // 4
                for s in range(0, n, length):
                    e = min(s + length, n)
                    at.append(i)
                    start.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s:4 * e]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, size, crc, total)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """Knapsack by dynamic programming: the worth and the classes of the best pattern."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        worth[w] = worth[w - 1]
        fits = np.searchsorted(sizes, w, side="right")
        if fits:
            gain = worth[w - sizes[:fits]] + prices[:fits]
            k = int(gain.argmax())
            if gain[k] > worth[w] + 1e-12:
                worth[w], last[w] = gain[k], k
    found, w = Counter(), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            found[int(last[w])] += 1
            w -= int(sizes[last[w]])
    return float(worth[capacity]), found


def largest_first(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {size: rests in each})]: always the largest rests that still fit."""
    left, made = dict(counts), []
    while any(left.values()):
        inside, room = Counter(), capacity
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            a = min(left[s], room // s)
            if a:
                inside[s] += a
                room -= a * s
        times = min(left[s] // a for s, a in inside.items())
        made.append((times, dict(inside)))
        for s, a in inside.items():
            left[s] -= times * a
    return made


def patterns(counts: dict[int, int], capacity: int, gap: float = GAP, max_steps: int = 20_000) -> list[tuple[int, dict[int, int]]]:
    """[(sequences, {size: rests in each})] that hold exactly ``counts`` rests of each size."""
    counts = {s: n for s, n in sorted(counts.items()) if n > 0}
    if not counts:
        return []
    sizes, need = np.array(list(counts)), np.array(list(counts.values()), float)
    m = len(sizes)
    basis = [Counter({k: capacity // int(s)}) for k, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // int(s)) for s in sizes])
    amount = inverse @ need
    for _ in range(max_steps):
        prices = inverse.sum(axis=0)
        worth, column = best_pattern(np.maximum(prices, 0.0), sizes, capacity)
        # total / worth bounds the optimum from below
        if worth <= 1 + gap:
            break
        entering = np.zeros(m)
        for k, a in column.items():
            entering[k] = a
        direction = inverse @ entering
        ratios = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1.0), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[out] = column
    made: Counter = Counter()
    left = {int(s): int(n) for s, n in counts.items()}
    for k in np.argsort(-amount, kind="stable"):
        inside = {int(sizes[c]): a for c, a in basis[k].items()}
        times = min([int(amount[k] + 1e-9), *(left[s] // a for s, a in inside.items())])
        if times > 0:
            made[tuple(sorted(inside.items()))] += times
            for s, a in inside.items():
                left[s] -= times * a
    for n, inside in largest_first(left, capacity):  # what rounding left
        made[tuple(sorted(inside.items()))] += n
    return [(n, dict(p)) for p, n in sorted(made.items())]


def plan(counts: dict[int, int], length: int, grain: int) -> tuple[pa.Table, int]:
    """Which ranks of a class go to which sequences, as a table bounded by patterns x classes, and the sequence count.

    ``counts`` has the rests of each class of ``rest_class``. A rest of rank r is member ``skip`` + (r - ``low``) / ``per``
    of its pattern's rests of one size, ``each`` of which share a sequence.
    """
    short, room = min(SHORT, length // grain * grain // 2), length // grain * grain
    # the members of each size, in units of grain: (how many, {class: rests in each})
    members: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for cls, n in sorted(counts.items()):
        if cls > short:
            members.setdefault(cls // grain, []).append((n, {cls: 1}))
    for n, inside in largest_first({s: n for s, n in counts.items() if s <= short}, min(BUNDLE, room)):
        members.setdefault(-(-sum(s * a for s, a in inside.items()) // grain), []).append((n, inside))
    rows, first, ranked = [], 0, Counter()
    for n, pattern in patterns({u: sum(k for k, _ in m) for u, m in members.items()}, length // grain):
        slot = 0
        for u, each in sorted(pattern.items(), reverse=True):
            skip = 0
            while skip < n * each:
                have, inside = members[u][0]
                taken = min(have, n * each - skip)
                for cls, per in inside.items():
                    rows.append((cls, ranked[cls], ranked[cls] + taken * per, per, skip, first, each, slot))
                    ranked[cls] += taken * per
                members[u][:1] = [(have - taken, inside)] if have > taken else []
                skip += taken
            slot += each
        first += n
    names = ["cls", "low", "high", "per", "skip", "first", "each", "slot"]
    return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)}), first


def rest_class(size: Column, length: int, grain: int) -> Column:
    """The length itself of a short rest, that of a longer one rounded up to the grain."""
    return F.when(size <= min(SHORT, length // grain * grain // 2), size).otherwise(F.ceil(size / grain) * grain).cast("long")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has at least its end id, so null and empty texts are one-token pieces. Equal rows are packed
    each. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    cut = Stored(pieces(docs, vocabulary, length, end_id), {"n": F.count(F.lit(1))})
    spread = lambda rows: hash_bucket(rows, "doc_id", "start", "ids_crc32")
    n = buckets_for(cut.measures["n"] or 0)
    order, one = ["doc_id", "start", "ids_crc32"], F.lit(1)
    rests = cut.table.where(F.col("length") < length).withColumn("cls", rest_class(F.col("length"), length, grain))
    counts = {int(r.cls): int(r["count"]) for r in rests.groupBy("cls").count().collect()}  # at most SHORT + length / grain rows
    dealt, used = plan(counts, length, grain)
    dealt = spark.createDataFrame(dealt, "cls long, low long, high long, per long, skip long, first long, each long, slot long")
    ranked = running_total(rests, spread(n), order, one, "rank", by=["cls"]).alias("r")
    p = F.broadcast(dealt).alias("p")  # bounded by the number of classes and patterns
    placed = ranked.join(p, (F.col("r.cls") == F.col("p.cls")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("skip") + F.floor((F.col("rank") - F.col("low")) / F.col("per"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = placed.select(*columns, (F.col("first") + F.floor(within / F.col("each"))).alias("sequence_id"), (F.col("slot") + within % F.col("each")).alias("place"), "r.cls", "rank")
    before = W.partitionBy("sequence_id").orderBy("place", "cls", "rank").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place", "cls", "rank")
    full = running_total(cut.table.where(F.col("length") == length), spread(n), order, one, "sequence_id")
    full = full.select(*columns, (F.col("sequence_id") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
