"""Hitting problems on product spaces by conjugate gradients with several products a job.

A job multiplies the direction p and the residual r by polynomials of the system up to degree s and keeps all of them;
one table of their inner products then lets the driver take s steps in coefficients. The system is scaled by
its diagonal, so its spectrum lies in [0, 2] and Chebyshev polynomials are a sound basis without an estimate. At the end
the residual is computed afresh; if rounding has let it drift, the solve goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrane.operators.spaces import Space
from terrane.plans.block_walk import BETWEEN, SCHEMA, BlockWalk, lists, matrix, packed, products, symmetric_rates, unpacked
from terrane.session import Stored

STEPS = 8


@dataclass
class Solution:
    table: DataFrame    # idx, x
    steps: int
    jobs: int


def _krylov(walk: BlockWalk, rows: DataFrame, held: int, mix: np.ndarray, degree: int) -> DataFrame:
    """Rows whose ``x`` holds (solution, p, r, T1 p, T1 r, .., Ts p, Ts r), T the Chebyshev polynomials of A + 1.

    ``mix`` makes (solution, p, r) from the ``held`` columns that ``x`` had; degree + 1 shuffles.
    """
    shape = walk.shape

    def stage(df: DataFrame, turn: int) -> DataFrame:
        block, done = walk.blocks[turn % 2], turn == degree

        def batches(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batch)
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            idx, y, g, leave = (t.column(c).to_numpy() for c in ("idx", "y", "g", "leave"))
            apply = shape.partial(block, idx, y, g, symmetric_rates)
            if turn == 0:
                v = matrix(t.column("x"), held) @ mix
            else:
                v, u = unpacked(t.column("x"), 2 * turn + 1), unpacked(t.column("u"), 2)
                last = v[:, -2:]
                # (A + 1) times the last pair
                new = u + apply(last) + (1.0 - leave[:, None]) * last
                v = np.hstack([v, new if turn == 1 else 2.0 * new - v[:, -4:-2]])
            fixed = [t.column(c) for c in ("idx", "y", "g", "leave", "root")]
            if done:
                out = pa.Table.from_arrays([*fixed, lists(v), lists(np.zeros((len(v), 0)))], names=["idx", "y", "g", "leave", "root", "x", "u"])
            else:
                out = pa.Table.from_arrays([*fixed, packed(v), packed(apply(v[:, -2:])), packed(np.zeros((len(v), 0)))],
                                           names=["idx", "y", "g", "leave", "root", "x", "u", "z"])
            yield from out.to_batches(max_chunksize=10_000)

        return walk._dealt(df, block, 2 * degree).mapInArrow(batches, SCHEMA if done else BETWEEN)

    df = rows.select("idx", "y", "g", "leave", "root", "x")
    for turn in range(degree + 1):
        df = stage(df, turn)
    return df


def _steps(inner: np.ndarray, degree: int, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, float]:
    """Up to ``degree`` steps in coefficients of the basis (p, r, T1 p, ..): what is added to the solution, p, r, steps, squared residual."""
    size = 2 * degree + 2
    system = np.zeros((size, size))     # minus A on the basis; the highest pair is never multiplied
    for k in range(degree):
        for c in (0, 1):
            system[2 * k + c, 2 * k + c] = 1.0
            system[2 * k + 2 + c, 2 * k + c] = -1.0 if k == 0 else -0.5
            if k:
                system[2 * k - 2 + c, 2 * k + c] = -0.5
    x, p, r = np.zeros(size), np.eye(size)[0], np.eye(size)[1]
    square = r @ inner @ r
    taken = 0
    while taken < degree and square > target:
        q = system @ p
        curve = p @ inner @ q
        if curve <= 0:
            break
        step = square / curve
        x, r = x + step * p, r - step * q
        new = max(r @ inner @ r, 0.0)
        p, square, taken = r + new / square * p, new, taken + 1
    return x, p, r, taken, square


def solve(walk: BlockWalk, rows: DataFrame, rtol: float = 1e-9, degree: int = STEPS, max_jobs: int = 400) -> Solution:
    """Solve -A x = b over rows whose ``x`` is [b] and whose ``leave`` is 1 (the diagonal, scaled)."""
    start = Stored(rows.select("idx", "y", "g", "leave", "root", F.array(F.lit(0.0), F.col("x")[0], F.col("x")[0]).alias("x")),
                   {"b": F.sum(F.col("x")[1] * F.col("x")[1])})
    scale = start.measures["b"] or 0.0
    target = rtol * rtol * scale
    if scale == 0.0:
        return Solution(start.table.select("idx", F.lit(0.0).alias("x")), 0, 1)
    df, held, mix, last, steps, jobs = start.table, 3, np.eye(3), None, 0, 1
    while jobs < max_jobs:
        step = Stored(_krylov(walk, df, held, mix, degree))
        if last is not None:
            last.drop()
        last, df, held = step, step.table, 2 * degree + 3
        inner = products(df, ["x"], [held])[1:, 1:]
        x, p, r, taken, square = _steps(inner, degree, target)
        steps, jobs = steps + taken, jobs + 1
        mix = np.zeros((held, 3))
        mix[0, 0] = 1.0
        mix[1:, 0], mix[1:, 1], mix[1:, 2] = x, p, r
        if square <= target or not taken:
            # residual of the solution itself
            new = " + ".join(f"{float(v)!r}D * x[{k}]" for k, v in enumerate(mix[:, 0]))
            found = df.selectExpr("idx", "y", "g", "leave", "root", f"array({new}) AS x")
            checked = walk.polynomial(found, 1, []).join(rows.select("idx", F.col("x")[0].alias("b")), "idx")
            checked = Stored(checked.select("idx", "y", "g", "leave", "root", F.array(F.col("x")[0], F.col("b") + F.col("u")[0], F.col("b") + F.col("u")[0]).alias("x")),
                             {"r": F.sum(F.col("x")[1] * F.col("x")[1])})
            jobs += 1
            if checked.measures["r"] <= 4 * target:
                last.drop()
                return Solution(checked.table.select("idx", F.col("x")[0].alias("x")), steps, jobs)
            last.drop()
            last, df, held, mix = checked, checked.table, 3, np.eye(3)
    raise RuntimeError(f"no convergence in {max_jobs} jobs")


def hitting_probability(nodes: DataFrame, space: Space, ns: float, one: DataFrame, zero: DataFrame, y: str = "y", p0: str | None = None, exchange=None,
                        out: str = "q", rtol: float = 1e-9, degree: int = STEPS) -> tuple[DataFrame, Solution]:
    """Probability of reaching ``one`` before ``zero`` from every state of a complete landscape ``(idx, y[, p0])``, and how it was solved.

    Both sets may be of any size. States of both are taken as ``one``.
    """
    walk = BlockWalk(space, ns, exchange)
    rows = walk.rows(nodes, y, p0)
    marked = rows.table.join(one.select("idx").distinct().withColumn("_one", F.lit(1.0)), "idx", "left")
    marked = marked.join(zero.select("idx").distinct().withColumn("_zero", F.lit(0.0)), "idx", "left")
    known = F.coalesce("_one", "_zero")
    # symmetric rates into the set, times the root of the frequency there
    marked = Stored(marked.select("idx", "y", "g", "leave", "root", known.alias("known"), F.array(F.coalesce("_one", F.lit(0.0)) * F.col("root")).alias("x")))
    into = walk.polynomial(marked.table.withColumn("leave", F.lit(0.0)), 1, []).select("idx", F.col("u")[0].alias("into"))
    scaled = marked.table.drop("x").join(into, "idx").where("known is null").select(
        "idx", "y", (F.col("g") / F.sqrt("leave")).alias("g"), F.lit(1.0).alias("leave"), (F.col("root") * F.sqrt("leave")).alias("root"),
        F.array(F.col("into") / F.sqrt("leave")).alias("x"))
    scaled = Stored(scaled)
    found = solve(walk, scaled.table, rtol, degree)
    q = found.table.join(scaled.table.select("idx", "root"), "idx").select("idx", (F.col("x") / F.col("root")).alias("_q"))
    solved = marked.table.select("idx", "known").join(q, "idx", "left").select("idx", F.coalesce("known", "_q").alias(out))
    return nodes.join(solved, "idx"), found
