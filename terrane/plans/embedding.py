"""Diffusion-axes embedding: slowest modes of the walk, and sweeps over selection strength."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from terrane.operators.ranking import hash_uniform
from terrane.operators.select import align_signs
from terrane.plans.solvers import by_target, edge_apply, lowest_modes
from terrane.plans.walk import calibrate_ns, stationary_frequencies, transition_rates
from terrane.session import cut


def diffusion_axes(nodes: DataFrame, rates: DataFrame, k: int = 10, p: str = "p", rtol: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``axis_1..axis_k`` and the table ``(k, decay_rates, relaxation_time)``.

    The map is I + M / bound with M the symmetric rate form, whose top eigenvector sqrt(pi) is
    known and kept out of the search. Axes are right eigenvectors of Q over sqrt(-lambda), with
    the sign that makes their mean non-negative.
    """
    spark = nodes.sparkSession
    rates = cut(rates.select("i", "j", "sym", "rate"))
    leave = rates.groupBy(F.col("i").alias("idx")).agg(F.sum("rate").alias("leave"), F.sum("sym").alias("out"))
    bound = leave.agg(F.max(F.col("leave") + F.col("out"))).first()[0]
    scaled = by_target(rates.select("i", "j", (F.col("sym") / F.lit(bound)).alias("w")))
    start = nodes.select("idx", F.sqrt(p).alias("root")).join(leave.select("idx", "leave"), "idx", "left")
    start = start.withColumn("diag", 1.0 - F.coalesce("leave", F.lit(0.0)) / F.lit(bound)).drop("leave")
    start = start.withColumn("q0", hash_uniform("idx", "start") - 0.5)
    shifted, modes = lowest_modes(start, edge_apply(scaled, "diag"), k, "root", rtol=rtol)
    values = bound * (shifted - 1.0)
    axes = {f"axis_{n + 1}": F.col(f"e{n}") / F.col("root") / F.lit(float(np.sqrt(-v))) for n, v in enumerate(values)}
    modes = cut(modes.select("idx", *[e.alias(a) for a, e in axes.items()]))
    scaled.unpersist()
    means = modes.agg(*[F.avg(a).alias(a) for a in axes]).first()
    modes = modes.withColumns({a: F.lit(-1.0 if means[a] < 0 else 1.0) * F.col(a) for a in axes})
    decay = spark.createDataFrame(
        [(n + 1, float(-v), float(-1.0 / v)) for n, v in enumerate(values)], "k int, decay_rates double, relaxation_time double"
    )
    return nodes.join(modes, "idx"), decay


def embed_landscape(nodes: DataFrame, edges: DataFrame, n: int, k: int = 10, ns: float | None = None, mean_function: float | None = None,
                    perc: float | None = None, y: str = "y", p0: str | None = None, exchange: str | None = None, rtol: float = 1e-8) -> tuple[float, DataFrame, DataFrame]:
    """Choose Ns, build the rates and embed: ``(Ns, nodes, decay rates)``."""
    if ns is None:
        ns = calibrate_ns(nodes, mean_function, perc, y, p0)
    freqs = stationary_frequencies(nodes, ns, y, p0, "p")
    rates = transition_rates(nodes, edges, ns, n, y, p0, exchange)
    placed, decay = diffusion_axes(freqs, rates, min(k, n - 2), rtol=rtol)
    return ns, placed.withColumnRenamed(y, "function").withColumnRenamed("p", "stationary_freq"), decay


def sweep_targets(nodes: DataFrame, n: int, pmin: float = 0.05, pmax: float = 0.8, y: str = "y") -> list[float]:
    """Evenly spaced mean values between fractions of the way from the mean to the maximum."""
    mean, top = nodes.agg(F.avg(y), F.max(y)).first()
    return [float(x) for x in np.linspace(mean + pmin * (top - mean), mean + pmax * (top - mean), n)]


def ns_sweep(nodes: DataFrame, edges: DataFrame, n: int, targets: Sequence[float], k: int = 3, y: str = "y", rtol: float = 1e-8) -> DataFrame:
    """Embeddings for several target means, each aligned in sign to the one before."""
    axes = [f"axis_{a + 1}" for a in range(k)]
    out, previous = None, None
    for step, target in enumerate(targets):
        ns, placed, _ = embed_landscape(nodes, edges, n, k, mean_function=target, y=y, rtol=rtol)
        placed = placed.select("idx", "seq", *axes)
        if previous is not None:
            placed = cut(align_signs(placed, previous, axes))
        previous = placed
        labelled = placed.withColumns({"step": F.lit(step), "target": F.lit(target), "ns": F.lit(ns)})
        out = labelled if out is None else out.unionByName(labelled)
    return out
