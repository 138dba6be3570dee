"""Krylov loops over state tables: the vectors are columns, the scalars are one aggregate a step.

A step is one job that writes the step table and takes its inner products on the way. Steps
survive lost executors, plans never grow, and a step is dropped once the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from terrane.session import Stored, keep

# adds one output column per input column: apply(df, ["p"], ["u"])
Apply = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


class Chain:
    """Keeps the newest step of a loop and drops the one before it."""

    def __init__(self):
        self.last: Stored | None = None

    def store(self, df: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
        step = Stored(df, measures)
        if self.last is not None:
            self.last.drop()
        self.last = step
        return step.table, step.measures


def dot(a: str, b: str, weight: str = "") -> Column:
    return F.expr(f"sum({weight and weight + ' * '}`{a}` * `{b}`)")


def num(x: float) -> str:
    """A double as SQL text."""
    return f"{float(x)!r}D"


def conjugate_gradient(system: DataFrame, apply: Apply, rhs: Sequence[str], diagonal: str | Sequence[str] | None = None,
                       rtol: float = 1e-9, max_steps: int = 1000, x0: Sequence[str] | None = None) -> DataFrame:
    """Solve A x = b for one or more right-hand sides of a symmetric positive (semi-)definite map.

    ``system`` holds the ``rhs`` columns and whatever ``apply`` needs; the result gains ``x_<rhs>``.
    All right-hand sides share every shuffle, each with its own step sizes. ``diagonal`` is the
    preconditioner as SQL text, one for all or one per right-hand side.
    """
    given = [diagonal] * len(rhs) if diagonal is None or isinstance(diagonal, str) else list(diagonal)
    inv = [f"(1D / ({d}))" if d is not None else "1D" for d in given]
    base = [f"`{c}`" for c in system.columns]
    x, r, p, u = ([f"{k}_{b}" for b in rhs] for k in ("x", "r", "p", "u"))
    if x0 is None:
        df = system.selectExpr(*base, *[f"0D AS `{c}`" for c in x], *[f"`{b}` AS `{c}`" for b, c in zip(rhs, r)])
    else:
        df = apply(system.selectExpr(*base, *[f"`{s}` AS `{c}`" for c, s in zip(x, x0)]), x, u)
        df = df.selectExpr(*base, *[f"`{c}`" for c in x], *[f"`{b}` - `{c}` AS `{d}`" for b, c, d in zip(rhs, u, r)])
    df = df.selectExpr("*", *[f"{w} * `{b}` AS `{c}`" for c, b, w in zip(p, r, inv)])
    measures = {}
    for k, b in enumerate(rhs):
        measures |= {
            f"pu{k}": dot(p[k], u[k]), f"rz{k}": dot(r[k], r[k], inv[k]), f"ru{k}": dot(r[k], u[k], inv[k]), f"uu{k}": dot(u[k], u[k], inv[k]),
            f"rr{k}": dot(r[k], r[k]), f"sru{k}": dot(r[k], u[k]), f"suu{k}": dot(u[k], u[k]), f"bb{k}": dot(b, b),
        }
    chain = Chain()
    for _ in range(max_steps):
        step, s = chain.store(apply(df, p, u), measures)
        s = {n: v or 0.0 for n, v in s.items()}
        alpha, beta, done = [], [], True
        for k in range(len(rhs)):
            target = rtol * rtol * s[f"bb{k}"]
            active = s[f"rr{k}"] > target and s[f"pu{k}"] > 0
            a = s[f"rz{k}"] / s[f"pu{k}"] if active else 0.0
            rz = max(s[f"rz{k}"] - 2 * a * s[f"ru{k}"] + a * a * s[f"uu{k}"], 0.0)
            rr = s[f"rr{k}"] - 2 * a * s[f"sru{k}"] + a * a * s[f"suu{k}"]
            alpha.append(a)
            beta.append(rz / s[f"rz{k}"] if active else 0.0)
            done = done and rr <= target
        moved = [f"`{x[k]}` + {num(alpha[k])} * `{p[k]}` AS `{x[k]}`" for k in range(len(rhs))]
        if done:
            return step.selectExpr(*base, *moved)
        rest = [f"`{r[k]}` - {num(alpha[k])} * `{u[k]}`" for k in range(len(rhs))]
        df = step.selectExpr(
            *base, *moved, *[f"{e} AS `{r[k]}`" for k, e in enumerate(rest)],
            *[f"{inv[k]} * ({e}) + {num(beta[k])} * `{p[k]}` AS `{p[k]}`" for k, e in enumerate(rest)],
        )
    raise RuntimeError(f"no convergence in {max_steps} steps")


def bicgstab(system: DataFrame, apply: Apply, b: str, rtol: float = 1e-9, max_steps: int = 1000) -> DataFrame:
    """Solve A x = b for a general map; adds column ``x``."""
    base = system.columns
    df = system.withColumns({"x": F.lit(0.0), "r": F.col(b), "h": F.col(b), "p": F.col(b)})
    chain = Chain()
    norm = None
    for _ in range(max_steps):
        step, m = chain.store(apply(df, ["p"], ["v"]), {"rho": dot("h", "r"), "hv": dot("h", "v"), "bb": dot(b, b)})
        norm = m["bb"] or 0.0
        if norm == 0.0:
            return step.select(*base, "x")
        if not m["rho"] or not m["hv"]:
            raise RuntimeError("the solver broke down: the residual is orthogonal to its start")
        rho, alpha = m["rho"], m["rho"] / m["hv"]
        half = step.withColumn("s", F.col("r") - F.lit(alpha) * F.col("v"))
        step, m = chain.store(apply(half, ["s"], ["t"]), {
            "ts": dot("t", "s"), "tt": dot("t", "t"), "ss": dot("s", "s"), "hs": dot("h", "s"), "ht": dot("h", "t"),
        })
        omega = m["ts"] / m["tt"] if m["tt"] > 0 else 0.0
        step = step.withColumns({
            "x": F.col("x") + F.lit(alpha) * F.col("p") + F.lit(omega) * F.col("s"),
            "r": F.col("s") - F.lit(omega) * F.col("t"),
        })
        if m["ss"] - 2 * omega * m["ts"] + omega * omega * m["tt"] <= rtol * rtol * norm:
            return step.select(*base, "x")
        if not omega:
            raise RuntimeError("the solver broke down: its second step has length zero")
        beta = (m["hs"] - omega * m["ht"]) / rho * (alpha / omega)
        df = step.withColumn("p", F.col("r") + F.lit(beta) * (F.col("p") - F.lit(omega) * F.col("v"))).select(*base, "x", "r", "h", "p")
    raise RuntimeError(f"no convergence in {max_steps} steps")


def lowest_modes(start: DataFrame, apply: Apply, k: int, deflate: str, basis: int | None = None, rtol: float = 1e-8, max_restarts: int = 60) -> tuple[np.ndarray, DataFrame]:
    """k largest eigenpairs of a symmetric map, orthogonal to the unit column ``deflate``.

    Thick-restart Lanczos with full re-orthogonalisation. The basis is a set of columns, the
    projections on all of them are one aggregate, and only m x m numbers reach the driver.
    ``start`` holds ``idx``, ``deflate`` and a start column ``q0``. Returns eigenvalues in
    decreasing order and a table with unit columns ``e0..``.
    """
    m = basis or max(2 * k + 10, 20)
    base = [c for c in start.columns if c != "q0"]
    chain = Chain()
    T = np.zeros((m, m))
    names = [f"q{i}" for i in range(m + 1)]
    projections = lambda over: {"_n": dot("w", "w"), **{c: dot("w", c) for c in over}}
    stored, first = chain.store(start.withColumn("w", F.col("q0")), projections([deflate]))
    df = _reduced(stored, [deflate], first).withColumn("q0", F.col("w") / F.lit(_norm(first, [deflate]))).drop("w")
    settled = 0
    for _ in range(max_restarts):
        j = settled
        while j < m:
            over = [deflate, *names[:j + 1]]
            step, row = chain.store(apply(df, [names[j]], ["w"]), projections(over))
            T[:j + 1, j] = T[j, :j + 1] = [row[c] for c in names[:j + 1]]
            step = _reduced(step, over, row)
            # a second pass removes what rounding left behind
            fix = step.agg(*[c.alias(n) for n, c in projections(over).items()]).first().asDict()
            residual = _norm(fix, over)
            j += 1
            exhausted = residual <= 1e-12 * max(abs(T).max(), 1e-300)
            if exhausted:
                df = step.drop("w")
                break
            df = _reduced(step, over, fix).withColumn(names[j], F.col("w") / F.lit(residual)).drop("w")
            values, vectors = np.linalg.eigh(T[:j, :j])
            if j >= k and np.all(residual * abs(vectors[-1, -k:]) <= rtol * np.maximum(abs(values[-k:]), 1e-300)):
                break
        values, vectors = np.linalg.eigh(T[:j, :j])
        order = np.argsort(values)[::-1]
        converged = exhausted or np.all(residual * abs(vectors[-1, order[:k]]) <= rtol * np.maximum(abs(values[order[:k]]), 1e-300))
        count = min(k, j) if converged else min(k + 5, j - 1)
        mix = lambda c: F.expr(" + ".join(f"{num(vectors[i, c])} * `{names[i]}`" for i in range(j)))
        if converged:
            return values[order[:count]], df.select(*base, *[mix(c).alias(f"e{n}") for n, c in enumerate(order[:count])])
        df = df.select(*base, *[mix(c).alias(names[n]) for n, c in enumerate(order[:count])], F.col(names[j]).alias(names[count]))
        T[:] = 0.0
        T[range(count), range(count)] = values[order[:count]]
        settled = count
    raise RuntimeError("eigenvectors did not converge")


def _reduced(df: DataFrame, over: Sequence[str], row: dict) -> DataFrame:
    """Subtract from ``w`` its projections on the ``over`` columns."""
    others = [f"`{c}`" for c in df.columns if c != "w"]
    return df.selectExpr(*others, "w - (" + " + ".join(f"{num(row[c])} * `{c}`" for c in over) + ") AS w")


def _norm(row: dict, over: Sequence[str]) -> float:
    return float(np.sqrt(max(row["_n"] - sum(row[c] ** 2 for c in over), 0.0)))


SMALL_EDGES = 100_000


def by_target(edges: DataFrame) -> DataFrame:
    """Edges laid out for repeated joins on ``j``, so a step shuffles vectors but not the edges.

    A small table is left as it is (the vector side is broadcast), and so is one with a hub that
    would fill a partition: adaptive execution splits that partition in each join instead.
    """
    stored = Stored(edges, {"n": F.count(F.lit(1))})
    n = stored.measures["n"] or 0
    if n <= SMALL_EDGES:
        return stored.table
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hub = stored.table.groupBy("j").count().agg(F.max("count")).first()[0]
    if hub * parts > 4 * n:
        return stored.table
    return keep(stored.table.repartition(parts, "j").sortWithinPartitions("j"))


def edge_apply(edges: DataFrame, diagonal: str, weight: str = "w", sign: float = 1.0) -> Apply:
    """Matrix of an edge table plus a diagonal column: sign * sum_j w_ij v_j + diagonal_i v_i."""
    def apply(df: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
        far = df.selectExpr("idx AS j", *[f"`{c}` AS `_{c}`" for c in cols])
        sums = edges.select("i", "j", weight).join(far, "j").groupBy(F.col("i").alias("idx")).agg(
            *[F.expr(f"sum(`{weight}` * `_{c}`) AS `_{o}`") for c, o in zip(cols, outs)]
        )
        held = [f"`{c}`" for c in df.columns]
        return df.join(sums, "idx", "left").selectExpr(*held, *[
            f"{num(sign)} * coalesce(`_{o}`, 0D) + `{diagonal}` * `{c}` AS `{o}`" for c, o in zip(cols, outs)
        ])
    return apply
