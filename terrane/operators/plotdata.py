"""Tables behind the figures: segments, rasters, histograms, limits and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.seqcols import char_at, log10_or_neg_inf
from terrane.operators.select import edge_coordinates


def segments(nodes: DataFrame, edges: DataFrame, axes: Sequence[str], unique: bool = True) -> DataFrame:
    """Two rows per edge, ``end`` 0 and 1, with the coordinates of that end."""
    e = edge_coordinates(nodes, edges, axes, unique)
    ends = F.array(*[
        F.struct(F.lit(n).alias("end"), *[F.col(f"{a}_{k}").alias(a) for a in axes]) for n, k in enumerate("ij")
    ])
    return e.select("i", "j", F.inline(ends))


def digitize(nodes: DataFrame, x: str, y: str, resolution: int) -> DataFrame:
    """Add integer pixels ``px``, ``py``; the aspect of the data sets both resolutions."""
    low = {c: nodes.agg(F.min(c)).scalar() for c in (x, y)}
    span = {c: nodes.agg(F.max(c) - F.min(c)).scalar() for c in (x, y)}
    bins = {x: F.floor(F.lit(resolution) * span[x] / span[y]), y: F.floor(F.lit(resolution) * span[y] / span[x])}
    pixel = lambda c: F.least(F.floor((F.col(c) - low[c]) / span[c] * bins[c]), bins[c] - 1).cast("bigint")
    return nodes.withColumns({"px": pixel(x), "py": pixel(y)})


def node_raster(nodes: DataFrame, x: str, y: str, resolution: int, color: str = "function", how: str = "first", sort_by: Column | None = None) -> DataFrame:
    """``(px, py, c)``: first value by an order (idx by default), sum, or maximum per pixel."""
    cells = digitize(nodes, x, y, resolution)
    value = {
        "first": F.min_by(color, sort_by if sort_by is not None else F.col("idx")),
        "sum": F.sum(color), "max": F.max(color),
    }[how]
    return cells.groupBy("px", "py").agg(value.alias("c"))


def edge_raster(nodes: DataFrame, edges: DataFrame, x: str, y: str, resolution: int, color: str | None = None, only_first: bool = False) -> DataFrame:
    """``(px, py, c)``: straight pixel lines of all edges, summed or first edge only."""
    cells = digitize(nodes, x, y, resolution).select("idx", "px", "py")
    ends = lambda k: cells.select(F.col("idx").alias(k), F.col("px").alias(f"x{k}"), F.col("py").alias(f"y{k}"))
    c = F.col(color) if color else F.lit(1.0)
    lines = edges.select("i", "j", c.alias("c")).join(ends("i"), "i").join(ends("j"), "j")
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    steps = F.greatest(F.abs(dx), F.abs(dy))
    walk = lines.select("i", "j", "c", "xi", "yi", dx.alias("dx"), dy.alias("dy"), steps.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), steps)).alias("k"))
    at = lambda start, d: (F.col(start) + F.signum(d).cast("bigint") * F.floor(F.abs(F.col(d)) * F.col("k") / F.greatest("n", F.lit(1)) + 0.5)).cast("bigint")
    pixels = walk.select("i", "j", "c", at("xi", "dx").alias("px"), at("yi", "dy").alias("py"))
    value = F.min_by("c", F.struct("i", "j")) if only_first else F.sum("c")
    return pixels.groupBy("px", "py").agg(value.alias("c"))


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """``(bin, n, centre)`` with the bin centre scaled to 0..1."""
    low, span = df.agg(F.min(c)).scalar(), df.agg(F.max(c) - F.min(c)).scalar()
    which = F.least(F.floor((F.col(c) - low) / span * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(c).isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("centre", (F.col("bin") + 0.5) / float(bins))


def density_scatter(density: DataFrame, frequency: str = "frequency", q: str = "Q_star") -> DataFrame:
    """log10 frequency against log10 density; unobserved rows sit at the smallest minus 0.5."""
    logs = density.withColumns({"logR": log10_or_neg_inf(frequency), "logQ": log10_or_neg_inf(q)})
    floor = density.where(F.col(frequency) > 0).agg(F.min(F.log10(frequency)) - 0.5).scalar()
    seen = F.col(frequency) > 0
    return logs.withColumn("observed", seen).withColumn("logR", F.when(seen, F.col("logR")).otherwise(floor))


def axis_limits(nodes: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row: common limits of the axes with 5 % padding."""
    ends = nodes.agg(
        F.least(*[F.min(a) for a in axes]).alias("lo"), F.greatest(*[F.max(a) for a in axes]).alias("hi")
    )
    pad = 0.05 * (F.col("hi") - F.col("lo"))
    return ends.select((F.col("lo") - pad).alias("axis_min"), (F.col("hi") + pad).alias("axis_max"))


def color_limits(nodes: DataFrame, color: str, vmin: float | None = None, vmax: float | None = None) -> DataFrame:
    low = F.lit(float(vmin)) if vmin is not None else F.min(color)
    high = F.lit(float(vmax)) if vmax is not None else F.max(color)
    return nodes.agg(F.count("*").alias("n"), low.alias("vmin"), high.alias("vmax")).drop("n")


def allele_grid(nodes: DataFrame, alleles: Sequence[str]) -> DataFrame:
    """``(site, allele, idx, has)``: one panel per site and allele over all nodes."""
    panels = F.array(*[
        F.struct(F.lit(s).alias("site"), F.lit(a).alias("allele"), (char_at("seq", s) == a).cast("int").alias("has"))
        for s, site in enumerate(alleles) for a in site
    ])
    return nodes.select("idx", F.inline(panels))
