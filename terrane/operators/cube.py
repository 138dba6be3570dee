"""Second moments of landscapes from marginal sums: one grouping-sets aggregation, no pair joins.

With A_S the sum over x_S of (sum of y over rows matching x_S) squared, the sum of y y' over the
ordered pairs that agree on exactly the sites S follows from the A_T, T containing S, by
inclusion-exclusion. Missing sequences are simply absent rows. Beyond 14 sites the same tables come from blocks
of sequences that are compared inside tasks (``pair_moments``).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.seqcols import char_at, total
from terrane.operators.pair_moments import pair_sums
from terrane.operators.replicates import merge_replicates
from terrane.operators.spaces import Space, int64
from terrane.plans.kernels import delta_lambdas, distance_lambdas, multiplicities, order_columns

MAX_CUBE_SITES = 14


def site_sums(obs: DataFrame, length: int, sets: Sequence[Sequence[int]] | None = None, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """``(keys, gid, s, n)``: sum and number of rows per grouping set of sites and value.

    ``gid`` has one bit per site that is summed out; site 0 is the highest bit.
    """
    if sets is None and length > MAX_CUBE_SITES:
        raise ValueError(f"the full cube is limited to {MAX_CUBE_SITES} sites")
    sets = sets if sets is not None else [s for k in range(length + 1) for s in combinations(range(length), k)]
    names = [f"_s{s}" for s in range(length)]
    rows = obs.select(*keys, F.col(y).cast("double").alias("_y"), *[char_at("seq", s).alias(c) for s, c in enumerate(names)])
    grouping = [[*keys, *[names[s] for s in chosen]] for chosen in sets]
    return rows.groupingSets(grouping, *keys, *names).agg(
        F.sum("_y").alias("s"), F.count("*").alias("n"), F.grouping_id().alias("gid")
    ).select(*keys, "gid", "s", "n")


def covariance_by_distance(obs: DataFrame, length: int, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """``(keys, d, cov, n)``: mean of y y' over ordered pairs at distance d, and the pair count.

    Replicates of a sequence are merged first. Counts are decimals, which pairs of billions of rows fit in.
    """
    merged = merge_replicates(obs, [*keys, "seq"], y)
    if length > MAX_CUBE_SITES:
        sums = pair_sums(merged, length, False, keys, y).withColumnRenamed("class", "d")
        return sums.select(*keys, "d", F.col("nn").alias("n"), F.when(F.col("nn") > 0, F.col("ss") / F.col("nn").cast("double")).otherwise(0.0).alias("cov"))
    squares = site_sums(merged, length, None, keys, y)
    levels = squares.groupBy(*keys, (F.lit(length) - F.bit_count("gid")).alias("t")).agg(*_squares())
    shares = F.array(*[
        F.array(*[
            F.struct(F.lit(length - k).cast("bigint").alias("d"), F.lit((-1) ** (t - k) * comb(t, k)).cast("bigint").alias("c"))
            for k in range(t + 1)
        ]) for t in range(length + 1)
    ])
    parts = levels.select(*keys, "ss", "nn", F.explode(F.element_at(shares, F.col("t") + 1)).alias("p"))
    return _mean(parts.groupBy(*keys, F.col("p.d").alias("d")))


COUNT = "decimal(38,0)"


def _squares() -> list[Column]:
    n = F.col("n").cast("decimal(19,0)")
    return [F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(n * n).cast(COUNT).alias("nn")]


def _mean(groups) -> DataFrame:
    out = groups.agg(F.sum(F.col("p.c") * F.col("ss")).alias("pairs"), F.sum((F.col("p.c") * F.col("nn")).cast(COUNT)).cast(COUNT).alias("n"))
    return out.withColumn("cov", F.when(F.col("n") > 0, F.col("pairs") / F.col("n").cast("double")).otherwise(0.0)).drop("pairs")


def covariance_on_space(states: DataFrame, space: Space, y: str = "y", known: str = "known") -> DataFrame:
    """Same table from zero-filled values on a complete regular space, for many sites.

    The distance-d adjacency is diagonal in the order projections, so the pair sums are weighted
    sums of projection norms: two shuffles of n rows instead of 2^l grouping sets.
    """
    l = space.length
    both = order_columns(states.select("idx", y, F.col(known).cast("double").alias("_o")), space, y, "_y")
    norms = order_columns(both, space, "_o", "_n").agg(
        *[F.sum(F.col(f"_{c}{k}") * F.col(f"_{c}{k}")).alias(f"{c}{k}") for c in "yn" for k in range(l + 1)]
    )
    rows = []
    for d in range(l + 1):
        eig = distance_lambdas(space, d)
        form = lambda c: total(F.lit(float(e)) * F.col(f"{c}{k}") for k, e in enumerate(eig))
        rows.append(F.struct(F.lit(d).cast("bigint").alias("d"), form("y").alias("pairs"), F.round(form("n")).cast(COUNT).alias("n")))
    out = norms.select(F.inline(F.array(*rows)))
    return out.select("d", F.when(F.col("n") > 0, F.col("pairs") / F.col("n").cast("double")).otherwise(0.0).alias("cov"), "n")


def covariance_by_fold(states: DataFrame, space: Space, folds: int) -> list[dict[str, list[tuple[float, float]]]]:
    """Per fold, ``(cov, n)`` by distance of its training and its test part, from complete vectors.

    ``states`` holds ``idx`` and, for the total and each fold k, the columns ``y``, ``o`` and ``y{k}``, ``o{k}``: values and
    0/1 marks that are zero elsewhere. What trains is the total minus the fold in every projection, so all folds share
    one pass over n rows, and the driver sees l + 1 numbers each.
    """
    l = space.length
    held = [f"{c}{k}" for c in "yo" for k in ("", *range(folds))]
    wide = order_columns(states.select("idx", *[F.col(c).cast("double").alias(c) for c in held]), space, {f"_{c}_": c for c in held})
    sums = []
    for k in range(folds):
        for c in "yo":
            for j in range(l + 1):
                test, rest = F.col(f"_{c}{k}_{j}"), F.col(f"_{c}_{j}") - F.col(f"_{c}{k}_{j}")
                sums += [F.sum(test * test).alias(f"test{c}{k}_{j}"), F.sum(rest * rest).alias(f"train{c}{k}_{j}")]
    row = wide.agg(*sums).first()
    eig = [distance_lambdas(space, d) for d in range(l + 1)]
    out = []
    for k in range(folds):
        found = {}
        for role in ("train", "test"):
            norm = {c: [row[f"{role}{c}{k}_{j}"] or 0.0 for j in range(l + 1)] for c in "yo"}
            pairs = [(sum(e * x for e, x in zip(eig[d], norm["y"])), round(sum(e * x for e, x in zip(eig[d], norm["o"])))) for d in range(l + 1)]
            found[role] = [(s / n if n else 0.0, float(n)) for s, n in pairs]
        out.append(found)
    return out


def covariance_by_sites(obs: DataFrame, length: int, y: str = "y") -> DataFrame:
    """``(sites, cov, n)`` per set of agreeing sites, written as a 0/1 string; beyond 14 sites only sets that some pair agrees on."""
    full = (1 << length) - 1
    merged = merge_replicates(obs, ["seq"], y)
    if length > MAX_CUBE_SITES:
        sums = pair_sums(merged, length, True, (), y)
        return sums.select(F.lpad(F.bin("class"), length, "0").alias("sites"), (F.col("ss") / F.col("nn").cast("double")).alias("cov"), F.col("nn").alias("n"))
    masks = site_sums(merged, length, None, (), y).groupBy((F.lit(full) - F.col("gid")).cast("bigint").alias("mask")).agg(*_squares())
    subsets = F.filter(F.sequence(int64(0), int64(full)), lambda s: s.bitwiseAND(F.col("mask")) == s)
    signed = F.transform(subsets, lambda s: F.struct(
        s.alias("sub"), F.when(F.bit_count(F.col("mask").bitwiseXOR(s)) % 2 == 0, 1).otherwise(-1).cast("bigint").alias("c")
    ))
    parts = masks.select("ss", "nn", F.explode(signed).alias("p"))
    out = _mean(parts.groupBy(F.col("p.sub").alias("mask")))
    return out.select(F.lpad(F.bin("mask"), length, "0").alias("sites"), "cov", "n")


def require_complete_regular(nodes: DataFrame, space: Space) -> None:
    space.alpha
    if nodes.count() != space.n:
        raise ValueError("needs a value for every state of the space")


def variance_components(nodes: DataFrame, space: Space, y: str = "y") -> DataFrame:
    """``(k, lambdas, m)``: squared projection on each order over its multiplicity."""
    sums = order_columns(nodes.select("idx", F.col(y).alias("v")), space).agg(
        *[F.sum(F.col(f"_k{k}") * F.col(f"_k{k}")).alias(f"q{k}") for k in range(space.length + 1)]
    )
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col(f"q{k}") / float(m)).alias("lambdas"), F.lit(float(m)).alias("m"))
        for k, m in enumerate(multiplicities(space))
    ])
    return sums.select(F.inline(rows))


def site_set_components(nodes: DataFrame, space: Space, k: int, y: str = "y") -> DataFrame:
    """``(sites, variance)`` for every set of k sites, from the means over at most k sites."""
    l, a = space.length, float(space.alpha)
    sets = [s for t in range(k + 1) for s in combinations(range(l), t)]
    sums = site_sums(nodes, l, sets, (), y)
    mask = (F.lit((1 << l) - 1) - F.col("gid")).cast("bigint")
    kept = (F.lit(l) - F.bit_count("gid"))
    mean = F.col("s") / F.col("n")
    level = sums.select(mask.alias("mask"), kept.alias("t"), (mean * mean * F.pow(F.lit(a), F.lit(l) - kept)).alias("u"))
    level = level.groupBy("mask", "t").agg(F.sum("u").alias("u"))
    targets = F.array(*[int64(sum(1 << (l - 1 - s) for s in j)) for j in combinations(range(l), k)])
    above = F.filter(targets, lambda j: j.bitwiseAND(F.col("mask")) == F.col("mask"))
    sign = F.when((F.lit(k) - F.col("t")) % 2 == 0, 1.0).otherwise(-1.0)
    parts = level.select((sign * F.col("u")).alias("u"), F.explode(above).alias("j"))
    return parts.groupBy("j").agg((F.sum("u") / (a - 1) ** k).alias("variance")).select(F.lpad(F.bin("j"), l, "0").alias("sites"), "variance")


def epistasis_cost(nodes: DataFrame, space: Space, p: int, y: str = "y") -> DataFrame:
    """One row: sum of squared P-way coefficients over all faces of a complete landscape."""
    vc = variance_components(nodes, space, y)
    lam = F.array(*[F.lit(float(x)) for x in delta_lambdas(space, p)])
    return vc.agg(F.sum(F.col("lambdas") * F.col("m") * F.element_at(lam, F.col("k") + 1)).alias("cost"))


def local_epistasis(obs: DataFrame, length: int, p: int, y: str = "y") -> DataFrame:
    """One row ``(s, n)``: sum and number of squared P-way coefficients over the faces present.

    Replicates are merged first. Each round takes differences between two alleles of one more site. A
    group holds at most one row per allele, so its list and its pairs are bounded by the alphabet.
    """
    rows = merge_replicates(obs, ["seq"], y).select("seq", F.col(y).cast("double").alias("v"), F.lit(-1).alias("last"), F.lit("").alias("face"))
    for _ in range(p):
        site = F.explode(F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda s: s > F.col("last"))).alias("site")
        keyed = rows.select("seq", "v", "face", site)
        masked = F.concat(F.substr("seq", F.lit(1), F.col("site")), F.lit("_"), F.substr("seq", F.col("site") + 2, F.lit(length)))
        cell = F.struct(F.substr("seq", F.col("site") + 1, F.lit(1)).alias("a"), F.col("v").alias("v"))
        groups = keyed.groupBy(masked.alias("seq"), "site", "face").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        groups = groups.where(F.size("cells") > 1)
        lower = groups.select("seq", "site", "face", "cells", F.posexplode("cells").alias("pos", "x"))
        upper = F.explode(F.slice("cells", F.col("pos") + 2, F.size("cells"))).alias("z")
        rows = lower.where(F.col("pos") + 1 < F.size("cells")).select("seq", "site", "face", "x", upper).select(
            "seq", (F.col("z.v") - F.col("x.v")).alias("v"), F.col("site").alias("last"),
            F.concat("face", F.col("x.a"), F.col("z.a")).alias("face"),
        )
    return rows.agg(F.sum(F.col("v") * F.col("v")).alias("s"), F.count("*").alias("n"))
