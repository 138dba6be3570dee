"""Slowest modes of a walk on a product space by Chebyshev-filtered subspace iteration, and their continuation over Ns.

A block of vectors is filtered by a polynomial that is small on the fast end of the spectrum and grows towards zero,
then rotated to Ritz vectors from one table of inner products. The fast end comes from a bound on the spectrum
(row sums), the cut from the slowest mode outside the block. The mode of rate zero, sqrt(pi), is known and
taken out. One filter is one job; a degree costs one shuffle of the rows (see :mod:`block_walk`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import acosh, ceil

import numpy as np
from pyspark.sql import DataFrame, functions as F

from terrane.operators.ranking import hash_uniform
from terrane.operators.spaces import Space
from terrane.plans.block_walk import BlockWalk, Step, products
from terrane.plans.walk import calibrate_ns
from terrane.session import Stored

GAIN = 1e5           # what a filter adds to the wanted end over the cut, at most
DEGREES = (4, 24)
FIRST_ORDER = 64     # columns a block may take for the modes of one site


def chebyshev_steps(low: float, cut: float, degree: int) -> list[Step]:
    """The filter that stays within 1 on [low, cut], scaled to be 1 at zero."""
    centre, half = (low + cut) / 2, (cut - low) / 2
    first = -half / centre
    steps, s = [Step(first / half, -centre * first / half, 0.0)], first
    for _ in range(degree - 1):
        new = 1 / (2 / first - s)
        steps.append(Step(2 * new / half, -2 * new * centre / half, -s * new))
        s = new
    return steps


def block_width(space: Space, k: int, spare: int | None = None) -> int:
    """Columns of the block: k, those of all modes of one site, and spare ones.

    Without selection the modes of one site share the slowest rates and the next ones are as fast again; under weak selection they
    lie close together. A block that ends among them gains little by a filter, one that holds them all ends at the gap.
    """
    if spare is None:
        first = sum(r - 1 for r in space.radices)
        return min(space.n - 1, (max(k, first) if first <= FIRST_ORDER else k) + max(5, k))
    return min(space.n - 1, k + spare)


@dataclass
class Modes:
    """``rates``: decay rates, slowest first. ``table``: idx, root and ``x``, whose columns combined by ``mix`` are the unit modes."""

    rates: np.ndarray
    table: Stored
    width: int
    mix: np.ndarray        # columns of (x, root) to modes; more columns than rates where the block has spare ones
    jobs: int
    degrees: int

    def modes(self, k: int) -> list[str]:
        """SQL text of the first k unit modes."""
        return [" + ".join(f"{float(self.mix[i, c])!r}D * x[{i}]" for i in range(self.width)) + f" + {float(self.mix[-1, c])!r}D * root" for c in range(k)]


def _ritz(inner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, mixes of (x, root) and residual norms, slowest first, from the products of (root, x, A x)."""
    g = inner[1:, 1:] - np.outer(inner[1:, 0], inner[0, 1:])    # without the part along root; A root is 0
    s, h, q = g[:width, :width], inner[1:width + 1, width + 1:], inner[width + 1:, width + 1:]
    scale = 1 / np.sqrt(np.maximum(np.diag(s), 1e-300))
    values, vectors = np.linalg.eigh(scale[:, None] * s * scale)
    kept = values > 1e-12 * values[-1]
    white = (scale[:, None] * vectors[:, kept]) / np.sqrt(values[kept])
    theta, turn = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
    order = np.argsort(-theta)
    theta, c = theta[order], white @ turn[:, order]
    square = np.einsum("ic,ij,jc->c", c, q, c) - 2 * theta * np.einsum("ic,ij,jc->c", c, h, c) + theta ** 2
    mix = np.vstack([c, -(inner[0, 1:width + 1] @ c)[None, :]])
    return theta, mix, np.sqrt(np.maximum(square, 0.0))


def slowest_modes(nodes: DataFrame, space: Space, ns: float, k: int, y: str = "y", p0: str | None = None, exchange: Sequence | None = None,
                  rtol: float = 1e-8, start: Modes | None = None, spare: int | None = None, max_filters: int = 60) -> Modes:
    """k slowest modes of a complete landscape ``(idx, y[, p0])``; ``start`` begins with the modes found for another Ns.

    Residuals end below ``rtol`` times the bound of the spectrum.
    """
    k = min(k, space.n - 1)
    walk = BlockWalk(space, ns, exchange)
    rows = walk.rows(nodes, y, p0)
    bound = max(rows.measures["bound"] or 0.0, 1e-300)
    width = block_width(space, k, spare)
    if start is None:
        df = rows.table.withColumn("x", F.array(*[hash_uniform("idx", f"start{c}") - 0.5 for c in range(width)]))
        mix = np.vstack([np.eye(width), np.zeros(width)])
    else:
        df = rows.table.join(start.table.table.select("idx", F.concat("x", F.array("root")).alias("x")), "idx")
        mix = np.vstack([start.mix[:, :width], np.zeros((1, min(width, start.mix.shape[1])))])
    held = mix.shape[0] - 1
    cut, last, jobs, degrees = -bound / 8, None, 0, 0
    for _ in range(max_filters):
        reach = acosh((bound - cut) / (bound + cut))    # of zero, in the scale of [-bound, cut]
        degree = int(np.clip(ceil(acosh(GAIN) / reach), *DEGREES))
        width = mix.shape[1]
        step = Stored(walk.polynomial(df, held, chebyshev_steps(-bound, cut, degree), mix))
        if last is not None:
            last.drop()
        last, df, held = step, step.table, width
        theta, mix, residual = _ritz(products(df, ["root", "x", "u"], [0, width, width]), width)
        jobs, degrees = jobs + 1, degrees + degree
        if len(theta) >= k and (residual[:k] <= rtol * bound).all():
            rows.drop()
            return Modes(-theta[:k], last, width, mix, jobs, degrees)
        if len(theta) < k:
            raise RuntimeError("the start vectors do not span the modes")
        cut = float(min(theta[-1], -1e-9 * bound))
        if not -bound < cut:
            cut = -bound / 2
    raise RuntimeError(f"no convergence after {max_filters} filters")


def diffusion_axes_on_space(nodes: DataFrame, space: Space, ns: float, k: int = 10, y: str = "y", p0: str | None = None, exchange: Sequence | None = None,
                            rtol: float = 1e-8, start: Modes | None = None) -> tuple[DataFrame, DataFrame, Modes]:
    """Nodes with ``p`` and ``axis_1..axis_k``, the table ``(k, decay_rates, relaxation_time)``, and the modes.

    What :func:`embedding.diffusion_axes` gives, for a complete landscape and without its edges. Axes are right
    eigenvectors over the root of the rate, with the sign that makes their mean non-negative.
    """
    found = slowest_modes(nodes, space, ns, k, y, p0, exchange, rtol, start)
    k = len(found.rates)
    names = [f"axis_{c + 1}" for c in range(k)]
    axes = found.table.table.selectExpr("idx", "root * root AS p", *[
        f"({m}) / root / {float(np.sqrt(r))!r}D AS {a}" for m, r, a in zip(found.modes(k), found.rates, names)])
    means = axes.agg(*[F.avg(a).alias(a) for a in names]).first()
    signs = [-1.0 if means[a] < 0 else 1.0 for a in names]
    axes = axes.select("idx", "p", *[(F.lit(s) * F.col(a)).alias(a) for s, a in zip(signs, names)])
    decay = nodes.sparkSession.createDataFrame([(c + 1, float(r), float(1 / r)) for c, r in enumerate(found.rates)], "k int, decay_rates double, relaxation_time double")
    return nodes.join(axes, "idx"), decay, found


def embed_landscape_on_space(nodes: DataFrame, space: Space, k: int = 10, ns: float | None = None, mean_function: float | None = None, perc: float | None = None,
                             y: str = "y", p0: str | None = None, exchange: Sequence | None = None, rtol: float = 1e-8) -> tuple[float, DataFrame, DataFrame]:
    """Choose Ns and embed a complete landscape: ``(Ns, nodes, decay rates)``, as :func:`embedding.embed_landscape`."""
    if ns is None:
        ns = calibrate_ns(nodes, mean_function, perc, y, p0)
    placed, decay, _ = diffusion_axes_on_space(nodes, space, ns, min(k, space.n - 2), y, p0, exchange, rtol)
    return ns, placed.withColumnRenamed(y, "function").withColumnRenamed("p", "stationary_freq"), decay


def ns_sweep_on_space(nodes: DataFrame, space: Space, targets: Sequence[float], k: int = 3, y: str = "y", rtol: float = 1e-6) -> DataFrame:
    """``(idx, axis_1.., step, target, ns)``: an embedding for each target mean.

    The modes of one target start the search of the next, and an axis takes the sign of its overlap with the axis before
    (pi-weighted inner product), so no signs are tried.
    """
    names = [f"axis_{c + 1}" for c in range(k)]
    out, before, previous = None, None, None
    for number, target in enumerate(targets):
        ns = calibrate_ns(nodes, mean_function=target, y=y)
        placed, _, before = diffusion_axes_on_space(nodes, space, ns, k, y, rtol=rtol, start=before)
        placed = Stored(placed.select("idx", "p", *names)).table
        if previous is not None:
            old = previous.select("idx", *[F.col(a).alias(f"_{a}") for a in names])
            overlaps = placed.join(old, "idx").agg(*[F.sum(F.col("p") * F.col(a) * F.col(f"_{a}")).alias(a) for a in names]).first()
            placed = placed.select("idx", "p", *[(F.lit(-1.0 if overlaps[a] < 0 else 1.0) * F.col(a)).alias(a) for a in names])
        previous = placed
        labelled = placed.select("idx", *names, F.lit(number).alias("step"), F.lit(float(target)).alias("target"), F.lit(float(ns)).alias("ns"))
        out = labelled if out is None else out.unionByName(labelled)
    return out
