"""Samples of aligned sequences: counts, re-weighting, frequencies, reduced alphabets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from terrane.constants import LETTERS
from terrane.functions.seqcols import subsequence, total
from terrane.session import small_rows

MAX_MASKS = 4096
BLOCK_ROWS = 1024


def sequence_counts(msa: DataFrame, seq: str = "seq") -> DataFrame:
    return msa.groupBy(seq).agg(F.count("*").alias("n"))


def repeated(counts: DataFrame, seq: str = "seq", n: str = "n", chunk: int = 65536) -> DataFrame:
    """One row per counted sequence; large counts are cut into chunks that spread over the cluster."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / chunk))
    pieces = counts.where(F.col(n) > 0).select(seq, n, F.explode(chunks).alias("_chunk")).repartition(seq, "_chunk")
    size = F.least(F.lit(chunk).cast("bigint"), F.col(n) - F.col("_chunk") * chunk)
    return pieces.select(seq, F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("_copy")).drop("_copy")


def max_mismatches(length: int, max_dist: float) -> int:
    """Largest m with m / length strictly below the cut-off; -1 when there is none."""
    m = ceil(max_dist * length) + 1
    while m >= 0 and not m / length < max_dist:
        m -= 1
    return min(m, length)


def similar_counts(msa: DataFrame, length: int, max_dist: float, seq: str = "seq", max_masks: int = MAX_MASKS) -> DataFrame:
    """``(seq, n, n_similar)`` per distinct sequence: rows closer than the cut-off, itself included.

    No pair is formed. With m allowed mismatches, let T_h be the number of rows that agree with a
    sequence outside h masked sites, summed over all masks of h sites. A row at distance d is in
    C(l-d, h-d) of them, so the counts per distance follow from T_0..T_m by a triangular sum.
    """
    m = max_mismatches(length, max_dist)
    unique = sequence_counts(msa, seq)
    if m < 0:
        return unique.withColumn("n_similar", F.lit(0).cast("bigint"))
    if sum(comb(length, h) for h in range(m + 1)) > max_masks:
        return banded_similar_counts(unique, length, m, seq)
    weights = _mask_weights(length, m)
    masks = []
    for h in range(m + 1):
        for hidden in combinations(range(length), h):
            kept = [s for s in range(length) if s not in hidden]
            key = subsequence(seq, kept) if kept else F.lit("")
            masks.append(F.struct(key.alias("key"), F.lit(weights[h]).cast("bigint").alias("w")))
    keyed = unique.select(seq, "n", F.posexplode(F.array(*masks)).alias("mask", "k"))
    keyed = keyed.select(seq, "n", "mask", F.col("k.key").alias("key"), F.col("k.w").alias("w"))
    groups = keyed.groupBy("mask", "key").agg(F.sum("n").alias("group_n"))
    near = keyed.join(groups, ["mask", "key"]).groupBy(seq).agg(
        F.first("n").alias("n"), F.sum(F.col("w") * F.col("group_n")).alias("n_similar")
    )
    return near


def _mask_weights(length: int, m: int) -> list[int]:
    """Integer weights of T_0..T_m whose sum counts each row at distance <= m once."""
    grid = np.array([[comb(length - d, h - d) if h >= d else 0 for h in range(m + 1)] for d in range(m + 1)], dtype=object)
    weights = [0] * (m + 1)
    for d in range(m, -1, -1):
        weights[d] = 1 - sum(grid[d][h] * weights[h] for h in range(d + 1, m + 1))
    return [int(w) for w in weights]


def banded_similar_counts(unique: DataFrame, length: int, m: int, seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Same counts for long alignments, where masks are too many.

    Sequences at most m mismatches apart agree on one of m + 1 segments. Rows that share a segment
    are cut into salted blocks and compared block against block inside tasks; a task sends back one
    number per row, never a pair, and a hot segment only means more blocks.
    """
    bounds = np.linspace(0, length, m + 2).astype(int)
    segments = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    cells = F.posexplode(F.array(*[F.substring(seq, a + 1, b - a) for a, b in segments])).alias("segment", "part")
    keyed = unique.select(seq, "n", cells)
    sizes = keyed.groupBy("segment", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    keyed = keyed.join(sizes, ["segment", "part"])
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64(F.col(seq)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    queries = keyed.select("segment", "part", "block", every, F.col(seq).alias("s"), "n", F.lit(True).alias("asks"))
    answers = keyed.select("segment", "part", every, F.col("block").alias("b"), F.col(seq).alias("s"), "n", F.lit(False).alias("asks"))
    answers = answers.select("segment", "part", F.col("other").alias("block"), F.col("b").alias("other"), "s", "n", "asks")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        segment = int(pdf["segment"].iloc[0])
        letters = np.array([np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in pdf["s"]])
        asks = pdf["asks"].to_numpy()
        left, right, n = letters[asks], letters[~asks], pdf["n"].to_numpy()[~asks]
        near = np.zeros(len(left), dtype=np.int64)
        for r, x in enumerate(left):
            differs = right != x
            ok = differs.sum(1) <= m
            for a, b in segments[:segment]:
                ok &= differs[:, a:b].any(1)
            near[r] = n[ok].sum()
        return pd.DataFrame({"seq": pdf["s"].to_numpy()[asks], "near": near})

    blocks = queries.unionByName(answers).groupBy("segment", "part", "block", "other")
    near = blocks.applyInPandas(compare, "seq string, near bigint").groupBy("seq").agg(F.sum("near").alias("n_similar"))
    return unique.select(F.col(seq).alias("seq"), "n").join(near, "seq").withColumnRenamed("seq", seq)


def msa_weights(msa: DataFrame, length: int, correct: bool = False, max_dist: float = 0.2, seq: str = "seq") -> DataFrame:
    """Rows with ``weight``: 1, or one over the number of similar rows."""
    if not correct:
        return msa.withColumn("weight", F.lit(1.0))
    near = similar_counts(msa, length, max_dist, seq).select(seq, (1.0 / F.col("n_similar")).alias("weight"))
    return msa.join(near, seq)


def msa_to_counts(msa: DataFrame, length: int, positions: Sequence[int] | None = None, weight: str | None = None,
                  correct: bool = False, max_dist: float = 0.2, seq: str = "seq") -> DataFrame:
    """``(seq, y)``: unique (sub)sequences and their summed weight."""
    if correct and not positions:
        raise ValueError("positions are needed for the similarity correction")
    if correct and weight:
        raise ValueError("the similarity correction excludes given weights")
    if correct:
        # similar counts are per distinct sequence, so weights are summed before any row is touched
        near = similar_counts(msa, length, max_dist, seq)
        rows = near.select(seq, (F.col("n") / F.col("n_similar")).alias("w"))
    else:
        rows = msa.select(seq, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return rows.groupBy(subsequence(seq, positions).alias("seq")).agg(F.sum("w").alias("y"))


def allele_frequencies(msa: DataFrame, weight: str | None = None, seq: str = "seq") -> DataFrame:
    """``(allele, freq)`` over all sites, optionally weighted."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = msa.select(w.alias("w"), F.explode(F.split(seq, "")).alias("allele")).where("allele <> ''")
    counts = cells.groupBy("allele").agg(F.sum("w").alias("w"))
    return counts.select("allele", (F.col("w") / counts.agg(F.sum("w")).scalar()).alias("freq"))


def frequency_map(freqs: DataFrame) -> dict[str, float]:
    return {r.allele: r.freq for r in small_rows(freqs.select("allele", "freq"), 1024, "allele frequencies")}


def reduced_code(msa: DataFrame, n_alleles: int | Sequence[int], length: int, weight: str | None = None,
                 keep_names: bool = True, last: str = "X", order: str = "row_id", seq: str = "seq") -> DataFrame:
    """``(site, allele, new)``: the most frequent alleles of each site keep a letter, the rest become ``last``."""
    limits = [n_alleles] * length if isinstance(n_alleles, int) else list(n_alleles)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = msa.select(w.alias("w"), F.col(order).alias("o"), F.posexplode(F.split(seq, "")).alias("site", "allele"))
    freq = cells.where("allele <> ''").groupBy("site", "allele").agg(F.sum("w").alias("w"), F.min("o").alias("first_seen"))
    rank = F.row_number().over(W.partitionBy("site").orderBy(F.desc("w"), "first_seen", "allele"))
    name = F.col("allele") if keep_names else F.substr(F.lit(LETTERS), F.col("r"), F.lit(1))
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("site") + 1)
    return freq.withColumn("r", rank).select("site", "allele", F.when(F.col("r") <= limit, name).otherwise(last).alias("new"))


def code_maps(code: DataFrame, length: int) -> list[dict[str, str]]:
    """Re-coding dictionaries for :func:`terrane.functions.seqcols.recode`."""
    maps: list[dict[str, str]] = [{} for _ in range(length)]
    for r in small_rows(code, length * 1024, "re-coding table"):
        maps[r.site][r.allele] = r.new
    return maps
