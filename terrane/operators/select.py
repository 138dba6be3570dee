"""Selections of genotypes and the edges they induce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, Window as W, functions as F

from terrane.functions.seqcols import (
    ambiguity_mapping, computed_once, hamming, pattern_regex, protein_regex, total, translate,
)
from terrane.operators.ranking import index_rank, order_statistics


def listed(nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A caller's list of labels as ``(pos, seq)`` rows."""
    return nodes.sparkSession.createDataFrame(list(enumerate(labels)), "pos bigint, seq string")


def region(nodes: DataFrame, max_values: Mapping[str, float] = {}, min_values: Mapping[str, float] = {}) -> DataFrame:
    """Strictly below every maximum and strictly above every minimum."""
    for c, v in max_values.items():
        nodes = nodes.where(F.col(c) < v)
    for c, v in min_values.items():
        nodes = nodes.where(F.col(c) > v)
    return nodes


def genotypes(nodes: DataFrame, chosen: DataFrame, key: str = "seq") -> DataFrame:
    """Nodes whose key is listed; ``pos`` is kept when the list carries an order."""
    if "pos" in chosen.columns:
        return nodes.join(chosen.select(key, "pos"), key)
    return nodes.join(chosen.select(key), key, "left_semi")


def induced_edges(edges: DataFrame, chosen: DataFrame, order: str = "idx", n: int | None = None) -> DataFrame:
    """Edges between chosen nodes with end points renumbered by the order of the selection."""
    if order == "pos":
        numbered = chosen.select("idx", F.col("pos").alias("new"))
    else:
        size = n or (chosen.agg(F.max("idx")).first()[0] or 0) + 1
        numbered = index_rank(chosen.select("idx"), "idx", size, "new")
    ends = lambda k: numbered.select(F.col("idx").alias(k), F.col("new").alias(f"new_{k}"))
    rest = [c for c in edges.columns if c not in ("i", "j")]
    out = edges.join(ends("i"), "i").join(ends("j"), "j")
    return out.select(F.col("new_i").alias("i"), F.col("new_j").alias("j"), *rest)


def path(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of a path in order, and the edges between consecutive ones."""
    picked = nodes.join(labels.select("seq", "pos"), "seq")
    return picked, path_edges(labels.withColumn("path", F.lit(0))).drop("path")


def path_edges(steps: DataFrame) -> DataFrame:
    """``(path, i, j)``: consecutive positions of every path.

    Positions are consecutive integers, so the next step is found by equality on (path, position)
    and a path of any length spreads over the cluster.
    """
    following = steps.select("path", (F.col("pos") - 1).alias("pos"), F.col("pos").alias("j"))
    return steps.select("path", "pos").join(following, ["path", "pos"]).select("path", F.col("pos").alias("i"), "j")


def within_distance(nodes: DataFrame, focal: DataFrame, d: int, length: int) -> DataFrame:
    """Nodes at Hamming distance at most d from any focal sequence.

    Sequences that differ in at most d sites agree on one of d + 1 segments, so candidates come from an
    equality join on segments, d + 1 keys a row whatever the length, and the distance decides.
    """
    if d >= length:
        return nodes.where(focal.limit(1).select(F.count(F.lit(1))).scalar() > 0)
    bounds = [length * k // (d + 1) for k in range(d + 2)]
    parts = F.posexplode(F.array(*[F.substring("seq", a + 1, b - a) for a, b in zip(bounds, bounds[1:])])).alias("segment", "part")
    asked = focal.select("seq").distinct().select(F.col("seq").alias("focal"), parts)
    near = nodes.select("seq").distinct().select("seq", parts).join(asked, ["segment", "part"])
    hits = near.where(hamming("seq", "focal", length) <= d).select("seq").distinct()
    return nodes.join(hits, "seq", "left_semi")


def matching(nodes: DataFrame, pattern: str) -> DataFrame:
    """Regular-expression search."""
    return nodes.where(F.col("seq").rlike(pattern))


def matching_ambiguous(nodes: DataFrame, pattern: str, kind: str) -> DataFrame:
    """Sequences an ambiguity pattern stands for; ``ord`` is their place in its expansion."""
    mapping = ambiguity_mapping(kind, len(pattern))
    rank = F.lit(0).cast("bigint")
    for s, (c, site) in enumerate(zip(pattern, mapping)):
        rank = rank * len(site[c]) + F.instr(F.lit(site[c]), F.substring("seq", s + 1, 1)) - 1
    return nodes.where(F.col("seq").rlike(pattern_regex(pattern, mapping))).withColumn("ord", rank)


def closest(nodes: DataFrame, focal: str, n: int, axes: Sequence[str] | None = None) -> DataFrame:
    """The n nodes nearest to a focal genotype in the embedding (squared Euclidean)."""
    axes = axes or embedding_axes(nodes)
    at = nodes.where(F.col("seq") == focal)
    d2 = total((F.col(a) - at.select(a).scalar()) * (F.col(a) - at.select(a).scalar()) for a in axes)
    return nodes.withColumn("d2", d2).orderBy("d2", "idx").limit(n)


def embedding_axes(nodes: DataFrame) -> list[str]:
    axes = []
    while str(len(axes) + 1) in nodes.columns:
        axes.append(str(len(axes) + 1))
    return axes


def highlight(nodes: DataFrame, patterns: Sequence[str], kind: str = "dna", protein: bool = False, table="Standard") -> DataFrame:
    """Label rows with the last pattern they match; rows holding any null are dropped."""
    nodes = nodes.na.drop()
    if protein:
        if "protein" not in nodes.columns:
            nodes = computed_once(nodes, "protein", translate("seq", table, 3 * max(len(p) for p in patterns)))
        tests = [F.col("protein").rlike(protein_regex(p)) for p in patterns]
    else:
        tests = [F.col("seq").rlike(pattern_regex(p, ambiguity_mapping(kind, len(p)))) for p in patterns]
    group = F.coalesce(*[F.when(t, p) for t, p in reversed(list(zip(tests, patterns)))])
    return computed_once(nodes, "group", group).where(F.col("group").isNotNull())


def shifted_motif(nodes: DataFrame, motif: str, length: int, kind: str = "dna", filler: str = "N") -> DataFrame:
    """``(shift, seq)``: rows that hold the motif at each offset."""
    tests = []
    for s in range(length - len(motif) + 1):
        padded = filler * s + motif + filler * (length - len(motif) - s)
        tests.append(F.struct(F.lit(s).alias("shift"), F.col("seq").rlike(pattern_regex(padded, ambiguity_mapping(kind, length))).alias("hit")))
    cells = nodes.withColumn("_t", F.explode(F.array(*tests))).where("_t.hit")
    return cells.withColumn("shift", F.col("_t.shift")).drop("_t")


def value_filter(nodes: DataFrame, y: str = "function", minimum: float | None = None, maximum: float | None = None,
                 top: int | None = None, bottom: int | None = None, strict: bool = False) -> DataFrame:
    """Threshold or top/bottom n rows. ``strict`` keeps only rows beyond the n-th value."""
    if minimum is not None:
        nodes = nodes.where(F.col(y) > minimum)
    if maximum is not None:
        nodes = nodes.where(F.col(y) < maximum)
    if top is not None:
        if strict:
            return nodes.where(F.col(y) > order_statistics(nodes, y, [nodes.count() - top])[0])
        return nodes.orderBy(F.desc(y), "idx").limit(top)
    if bottom is not None:
        if strict:
            return nodes.where(F.col(y) < order_statistics(nodes, y, [bottom - 1])[0])
        return nodes.orderBy(y, "idx").limit(bottom)
    return nodes


def count_floor(counts: DataFrame, column: str, floor: float) -> DataFrame:
    return counts.where(F.col(column) >= floor).na.drop()


def sort_nodes(nodes: DataFrame, by: str | None = None, color: str = "function") -> DataFrame:
    """Order by a column, the colour column by default; untouched when neither exists."""
    by = by or color
    return nodes.orderBy(by) if by in nodes.columns else nodes


def sign_alignment(nodes: DataFrame, reference: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row: the axis signs with the least mean Euclidean distance to ``reference``."""
    right = reference.select("seq", *[F.col(a).alias(f"_r{a}") for a in axes])
    both = nodes.select("seq", *axes).join(right, "seq")
    combos = list(product([1, -1], repeat=len(axes)))
    distance = lambda signs: F.avg(F.sqrt(total(
        (F.lit(float(g)) * F.col(a) - F.col(f"_r{a}")) * (F.lit(float(g)) * F.col(a) - F.col(f"_r{a}")) for g, a in zip(signs, axes)
    )))
    scored = both.agg(*[distance(c).alias(f"_d{i}") for i, c in enumerate(combos)])
    options = F.array(*[
        F.struct(F.col(f"_d{i}").alias("distance"), F.lit(i).alias("combo"), *[F.lit(g).alias(a) for g, a in zip(c, axes)])
        for i, c in enumerate(combos)
    ])
    return scored.select(F.array_min(options).alias("b")).select("b.distance", *[F.col(f"b.{a}").alias(a) for a in axes])


def align_signs(nodes: DataFrame, reference: DataFrame, axes: Sequence[str]) -> DataFrame:
    best = sign_alignment(nodes, reference, axes)
    return nodes.withColumns({a: F.col(a) * best.select(a).scalar() for a in axes})


def edge_coordinates(nodes: DataFrame, edges: DataFrame, axes: Sequence[str], unique: bool = True) -> DataFrame:
    """End-point coordinates of edges, each undirected edge once by default."""
    e = edges.select("i", "j")
    if unique:
        e = e.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).distinct()
    ends = lambda k: nodes.select(F.col("idx").alias(k), *[F.col(a).alias(f"{a}_{k}") for a in axes])
    return e.join(ends("i"), "i").join(ends("j"), "j")


def complement(states: DataFrame, subset: DataFrame) -> DataFrame:
    return states.join(subset.select("idx"), "idx", "left_anti")


def require_disjoint(start: DataFrame, end: DataFrame) -> None:
    if start.select("idx").intersect(end.select("idx")).limit(1).count():
        raise ValueError("start and end share states")


def union_states(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("idx")
    for s in sets[1:]:
        out = out.union(s.select("idx"))
    return out.distinct()


def single_mutants(nodes: DataFrame, space, focal: str, centre: bool = False, y: str = "y") -> DataFrame:
    """``(site, allele, y, effect)`` of every sequence that has at most one change from ``focal``."""
    spark = nodes.sparkSession
    sites = space.sites(spark)
    mutant = F.concat(
        F.substr(F.lit(focal), F.lit(1), F.col("site")), F.col("allele"),
        F.substr(F.lit(focal), F.col("site") + 2, F.lit(len(focal))),
    )
    base = nodes.where(F.col("seq") == focal).select(y).scalar()
    out = sites.select("site", "allele", mutant.alias("seq")).join(nodes.select("seq", y), "seq")
    out = out.withColumn("effect", F.col(y) - base)
    if centre:
        out = out.withColumn("effect", F.col("effect") - F.avg("effect").over(W.partitionBy("site")))
    return out
