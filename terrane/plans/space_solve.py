"""Regression systems on complete product spaces by conjugate gradients with several products a job.

A system is m C m + d for a kernel C that has one eigenvalue per interaction order, a mask m and a diagonal d; each
right-hand side may have a kernel, mask and diagonal of its own. Folds, scales and contrasts are so many columns of one solve.

Sites are split into two blocks. A product of C is begun where rows that differ inside the first block are together: there a
vector is split into its parts by interaction order inside the block. One shuffle brings the rows of the other block together,
where the parts are split further and added up with their eigenvalues. The rows that end one product lie right for beginning the
next, so d products take d + 1 shuffles. Inside a task the splits are means over the axes of dense arrays.

A job multiplies the direction and the residual by Chebyshev polynomials of the system up to degree s and keeps all of them; a table of
their inner products then lets the driver take s steps in coefficients. The system is scaled by its diagonal. The bound of its
spectrum is the largest row of C's largest eigenvalue plus d, so no estimate is needed. At the end the residual is computed
afresh and compared, unscaled, with the right-hand side; the solve goes on from there while rounding has let it drift.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrane.operators.spaces import Space, block_key_sql, site_blocks
from terrane.plans import kernels as K
from terrane.plans.block_walk import LEAST_BYTES, TASK_BYTES, lists, matrix, packed, unpacked
from terrane.plans.solvers import num
from terrane.session import Stored

STEPS = 8
BATCH_BYTES = 8 << 20
ROUNDING = 64 * 2.0 ** -52     # of a residual, relative to the bound of the system times the solution
SCHEMA = "idx long, w array<double>, x array<double>"
BETWEEN = "idx long, w binary, x binary, u binary"   # packed, on the way


def split_orders(parts: list[np.ndarray], radices: Sequence[int]) -> list[np.ndarray]:
    """Parts of dense vectors (cells, columns) by the number of sites that interact: one more part for each site."""
    for k, a in enumerate(radices):
        means = [_mean(v, a, prod(radices[k + 1:])) for v in parts]
        rests = [v - m for v, m in zip(parts, means)]
        parts = [means[0], *[m + r for m, r in zip(means[1:], rests)], rests[-1]]
    return parts


def join_orders(parts: list[np.ndarray], radices: Sequence[int]) -> np.ndarray:
    """Sum of the order-j share of part j over all j, for len(radices) + 1 parts."""
    for k, a in enumerate(radices):
        means = [_mean(v, a, prod(radices[k + 1:])) for v in parts]
        parts = [means[j] + parts[j + 1] - means[j + 1] for j in range(len(parts) - 1)]
    return parts[0]


def _mean(v: np.ndarray, a: int, inner: int) -> np.ndarray:
    """Mean over one site, repeated for its alleles."""
    dense = v.reshape(-1, a, inner, v.shape[1])
    return np.broadcast_to(dense.mean(axis=1, keepdims=True), dense.shape).reshape(v.shape)


@dataclass(frozen=True)
class Block:
    """What a task needs to know of one block of sites."""

    radices: tuple[int, ...]    # of the sites of the block
    strides: tuple[int, ...]

    def order(self, idx: np.ndarray) -> np.ndarray:
        """Rows sorted by the letters outside the block, then inside; all rows of a group must be there."""
        place, rest = np.zeros(len(idx), dtype=np.int64), idx.copy()
        for a, stride in zip(self.radices, self.strides):
            digit = idx // stride % a
            place = place * a + digit
            rest -= digit * stride
        size = prod(self.radices)
        order = np.lexsort((place, rest))
        if len(idx) % size or (place[order] != np.arange(len(idx)) % size).any():
            raise ValueError("the table must hold every state of the space once")
        return order


class System:
    """(m_c C_c m_c + d_c) x_c = b_c for columns c of one state table; tables of ``SCHEMA`` hold their scaled form.

    ``w`` holds for each column the scaled mask, the scaled diagonal and the scaled right-hand side; ``x`` holds vectors
    with the columns in the inner position.
    """

    def __init__(self, space: Space, lambdas: Sequence[Sequence[float]]):
        self.space, self.lambdas = space, np.array(lambdas, dtype=float)
        blocks = site_blocks(space)
        self.sites = blocks if len(blocks) == 2 else [blocks[0], []]
        self.blocks = [Block(tuple(space.radices[s] for s in b), tuple(space.strides[s] for s in b)) for b in self.sites]
        self.columns = len(self.lambdas)

    def _dealt(self, df: DataFrame, turn: int, row_bytes: int) -> DataFrame:
        held = self.space.n * row_bytes
        parts = max(ceil(held / TASK_BYTES), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(held / LEAST_BYTES)))
        return df.selectExpr("*", f"{block_key_sql(self.space, self.sites[turn % 2])} AS _block").repartition(parts, "_block").drop("_block")

    def _products(self, rows: DataFrame, held: int, degree: int, start: Callable, grow: Callable, finish: Callable) -> DataFrame:
        """Rows after ``degree`` products of the system, degree + 1 shuffles.

        ``start`` makes the first vectors (rows, any, columns) of those that were held; the last ``grow.width`` of them are
        multiplied, ``grow`` adds to the vectors what it makes of the product, ``finish`` gives those that are written.
        """
        n, lam, blocks, pair = self.columns, self.lambdas, self.blocks, grow.width

        def stage(df: DataFrame, turn: int, row_bytes: int) -> DataFrame:
            here, far, done = blocks[turn % 2], blocks[(turn + 1) % 2], turn == degree
            size = len(far.radices) + 1     # parts that the stage before has made

            def batches(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = list(batch)
                if not parts:
                    return
                t = pa.Table.from_batches(parts)
                idx = t.column("idx").to_numpy()
                order = here.order(idx)
                idx = idx[order]
                if turn == 0:
                    w = matrix(t.column("w"), 3 * n)[order]
                    v = start(matrix(t.column("x"), held * n)[order].reshape(len(idx), held, n))
                else:
                    w = unpacked(t.column("w"), 3 * n)[order]
                    vectors = start.width + grow.grown * (turn - 1)
                    v = unpacked(t.column("x"), vectors * n)[order].reshape(len(idx), vectors, n)
                    u = unpacked(t.column("u"), size * pair * n)[order].reshape(len(idx), size, pair, n)
                    # parts by the order inside this block, each weighted with the eigenvalue of both orders together
                    weighted = [np.einsum("ripc,ci->rpc", u, lam[:, j:j + size]).reshape(len(idx), -1) for j in range(len(here.radices) + 1)]
                    product = join_orders(weighted, here.radices).reshape(len(idx), pair, n)
                    product = w[:, None, :n] * product + w[:, None, n:2 * n] * v[:, -pair:]
                    v = np.concatenate([v, grow(turn, v, product)], axis=1)
                if done:
                    v = finish(v, w[:, 2 * n:])
                    out = [lists(w), lists(v.reshape(len(idx), -1))]
                else:
                    masked = (w[:, None, :n] * v[:, -pair:]).reshape(len(idx), -1)
                    u = np.stack(split_orders([masked], here.radices), axis=1)
                    out = [packed(w), packed(v.reshape(len(idx), -1)), packed(u.reshape(len(idx), -1))]
                table = pa.Table.from_arrays([pa.array(idx), *out], names=["idx", "w", "x", *([] if done else ["u"])])
                yield from table.to_batches(max_chunksize=max(1, BATCH_BYTES // row_bytes))

            return self._dealt(df, turn, row_bytes).mapInArrow(batches, SCHEMA if done else BETWEEN)

        row_bytes = 8 * n * (3 + start.width + grow.grown * degree + pair * (2 + max(len(b.radices) for b in blocks)))
        for turn in range(degree + 1):
            rows = stage(rows, turn, row_bytes)
        return rows

    def krylov(self, rows: DataFrame, held: int, mix: np.ndarray, degree: int, tops: np.ndarray) -> DataFrame:
        """``x`` becomes (solution, p, r, T1 p, T1 r, ..), T the Chebyshev polynomials of 2 A / top - 1; ``mix`` makes the first three."""
        return self._products(rows, held, degree, _Mixed(mix), _Chebyshev(tops), lambda v, b: v)

    def product(self, rows: DataFrame) -> DataFrame:
        """``x`` (one vector) becomes A x."""
        return self._products(rows, 1, 1, _Mixed(np.ones((self.columns, 1, 1))), _Plain(), lambda v, b: v[:, 1:])

    def residual(self, rows: DataFrame, held: int, mix: np.ndarray) -> DataFrame:
        """``x`` becomes (solution, r, r) with r = b - A x computed afresh."""
        def finish(v: np.ndarray, b: np.ndarray) -> np.ndarray:
            r = b - v[:, 1]
            return np.stack([v[:, 0], r, r], axis=1)
        return self._products(rows, held, 1, _Mixed(mix[:, :, :1]), _Plain(), finish)

    def inner(self, table: DataFrame, held: int, of: Callable, size: int) -> np.ndarray:
        """Inner products (columns, size, size) of the vectors that ``of(x, w)`` gives; one row per entry and task is summed in Spark."""
        n = self.columns

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((n, size, size))
            for b in rows:
                t = pa.Table.from_batches([b])
                v = of(matrix(t.column("x"), held * n).reshape(-1, held, n), matrix(t.column("w"), 3 * n))
                v = np.ascontiguousarray(v.transpose(2, 1, 0))
                sums += v @ v.transpose(0, 2, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["at", "v"])

        out = np.zeros(n * size * size)
        for r in table.select("x", "w").mapInArrow(batches, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(n, size, size)


class _Mixed:
    """First vectors: combinations of those held, by column; ``mix`` is (columns, held, new)."""

    def __init__(self, mix: np.ndarray):
        self.mix, self.width = mix, mix.shape[2]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("rhc,chk->rkc", x, self.mix)


class _Chebyshev:
    """Next pair of polynomials of the two last vectors; ``tops`` bounds the spectrum of each column."""

    width = grown = 2

    def __init__(self, tops: np.ndarray):
        self.tops = tops

    def __call__(self, turn: int, v: np.ndarray, product: np.ndarray) -> np.ndarray:
        new = 2.0 / self.tops * product - v[:, -2:]
        return new if turn == 1 else 2.0 * new - v[:, -4:-2]


class _Plain:
    """The product itself."""

    width = grown = 1

    def __call__(self, turn: int, v: np.ndarray, product: np.ndarray) -> np.ndarray:
        return product


def take_steps(inner: np.ndarray, degree: int, top: float, target: float) -> tuple[np.ndarray, int, float]:
    """Up to ``degree`` steps in coefficients of (p, r, T1 p, T1 r, ..): what is added to the solution, p and r as columns; steps; squared residual."""
    size = 2 * degree + 2
    system = np.zeros((size, size))     # A = top / 2 (T1 + 1) on the basis; the highest pair is never multiplied
    for k in range(degree):
        for c in (0, 1):
            at = 2 * k + c
            system[at, at] = top / 2
            system[at + 2, at] = top / 2 if k == 0 else top / 4
            if k:
                system[at - 2, at] = top / 4
    x, p, r = np.zeros(size), np.eye(size)[0], np.eye(size)[1]
    square, taken = float(r @ inner @ r), 0
    while taken < degree and square > target:
        q = system @ p
        curve = p @ inner @ q
        if curve <= 0:
            break
        x, r = x + square / curve * p, r - square / curve * q
        new = max(float(r @ inner @ r), 0.0)
        p, square, taken = r + new / square * p, new, taken + 1
    return np.stack([x, p, r], axis=1), taken, square


def solve(states: DataFrame, space: Space, lambdas: Sequence[Sequence[float]], rhs: Sequence[str], diagonal: str | Sequence[str],
          mask: str | Sequence[str | None] | None = None, rtol: float = 1e-9, degree: int = STEPS, max_jobs: int = 400) -> DataFrame:
    """Solve (m C m + d) x = b for each column ``b`` of ``rhs`` over a complete state table: adds ``x_<b>``.

    ``lambdas`` holds the eigenvalues of C for each right-hand side. ``diagonal`` (d) and ``mask`` (a condition, all states
    without one) are SQL text, one for all or one for each; right-hand sides count as zero outside the mask, and so
    are the solutions. Every system must be positive (semi-)definite. A residual that cannot be told
    from rounding ends the solve as well.
    """
    n = len(rhs)
    diagonals = [diagonal] * n if isinstance(diagonal, str) else list(diagonal)
    masks = [mask] * n if mask is None or isinstance(mask, str) else list(mask)
    system = System(space, lambdas)
    inside = [f"coalesce({m}, false)" if m else "true" for m in masks]
    whole = [f"({d} + {num(np.dot(order_shares(space), lam))})" for d, lam in zip(diagonals, lambdas)]
    scale = [f"IF({i} AND {a} > 0D, 1D / sqrt({a}), 0D)" for i, a in zip(inside, whole)]
    scaled = states.selectExpr("idx", *[f"{s} AS _s{k}" for k, s in enumerate(scale)],
                               *[f"_s{k} * _s{k} * ({d}) AS _d{k}" for k, d in enumerate(diagonals)],
                               *[f"IF(_s{k} = 0D, 0D, _s{k} * `{b}`) AS _b{k}" for k, b in enumerate(rhs)])
    part = lambda c: [f"CAST(_{c}{k} AS DOUBLE)" for k in range(n)]
    rows = scaled.selectExpr("idx", f"array({', '.join([*part('s'), *part('d'), *part('b')])}) AS w", f"array({', '.join(['0D'] * n + part('b') * 2)}) AS x",
                             *[f"_s{k} * _s{k} * {num(max(lam))} + _d{k} AS _t{k}" for k, lam in enumerate(lambdas)])
    start = Stored(rows.select("idx", "w", "x", *[f"_t{k}" for k in range(n)]), {f"t{k}": F.max(f"_t{k}") for k in range(n)})
    tops = np.array([max(start.measures[f"t{k}"] or 0.0, 1e-300) for k in range(n)])
    unscale = lambda v, w: np.where(w[:, :n] > 0, v / np.where(w[:, :n] > 0, w[:, :n], 1.0), 0.0)
    norms = system.inner(start.table, 3, lambda v, w: np.stack([v[:, 1], unscale(v[:, 1], w)], axis=1), 2)
    given, own = norms[:, 0, 0], norms[:, 1, 1]
    targets = rtol * rtol * given
    last, df, held, mix, jobs = start, start.table.select("idx", "w", "x"), 3, np.tile(np.eye(3), (n, 1, 1)), 0
    worst = np.full(n, np.inf)
    while jobs < max_jobs:
        if (given > 0).any():
            step = Stored(system.krylov(df, held, mix, degree, tops))
            last.drop()
            last, df, held = step, step.table, 2 * degree + 3
            inner = system.inner(df, held, lambda v, w: v[:, 1:], 2 * degree + 2)
            mix, done, jobs = np.zeros((n, held, 3)), True, jobs + 1
            mix[:, 0, 0] = 1.0
            for c in range(n):
                mix[c, 1:], taken, square = take_steps(inner[c], degree, tops[c], targets[c])
                done = done and (square <= targets[c] or not taken)
            if not done:
                continue
        step = Stored(system.residual(df, held, mix))
        last.drop()
        last, df, held, mix, jobs = step, step.table, 3, np.tile(np.eye(3), (n, 1, 1)), jobs + 1
        norms = system.inner(df, 3, lambda v, w: np.stack([v[:, 1], unscale(v[:, 1], w), v[:, 0]], axis=1), 3)
        left, rounding = norms[:, 1, 1], (ROUNDING * tops) ** 2 * norms[:, 2, 2]
        open_ = (left > 4 * rtol * rtol * own) & (norms[:, 0, 0] > rounding)
        if not open_.any():
            found = df.selectExpr("idx", *[f"IF(w[{k}] > 0D, x[{k}] * w[{k}], 0D) AS `x_{b}`" for k, b in enumerate(rhs)])
            return states.join(found, "idx")
        if (left[open_] > 0.25 * worst[open_]).any():
            raise RuntimeError(f"the residual stays at {np.sqrt(left[open_] / own[open_])} of the right-hand side, {rtol} is asked for")
        worst = left
        # the unscaled residual is still too large: aim lower in the scaled one
        targets = np.where(open_, targets * np.minimum(1.0, 0.25 * rtol * rtol * own / np.maximum(left, 1e-300)), np.inf)
    raise RuntimeError(f"no convergence in {max_jobs} jobs")


def order_shares(space: Space) -> np.ndarray:
    """Diagonal entry of the projection on each order."""
    return K.multiplicities(space) / space.n


def apply(states: DataFrame, space: Space, lambdas: Sequence[Sequence[float]], columns: Sequence[str]) -> DataFrame:
    """``(idx, f0, f1, ..)``: each column times the kernel with its own eigenvalues, two shuffles for all."""
    n = len(columns)
    zeros, ones = ["0D"] * n, ["1D"] * n
    rows = states.selectExpr("idx", f"array({', '.join(ones + zeros + zeros)}) AS w", f"array({', '.join(f'CAST(`{c}` AS DOUBLE)' for c in columns)}) AS x")
    return System(space, lambdas).product(rows).selectExpr("idx", *[f"x[{k}] AS f{k}" for k in range(n)])
