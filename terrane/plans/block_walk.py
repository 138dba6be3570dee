"""Repeated products with the rate matrix of a landscape on a product space, one shuffle a product, no edge table.

Sites are split into two blocks. Rows that differ inside a block only are brought together by one shuffle and
multiplied there as small dense arrays (alleles of one site against each other, for all rows of the task at once). A product needs
both blocks, but the rows that end one product lie right for beginning the next, so a polynomial of degree d takes d + 1
shuffles of the rows. Vectors are one array column, a block of them costs no more shuffles than one.

Rows that are not in the table take no part: leaving states out gives the walk killed there, which is the system
of a hitting problem.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrane.operators.spaces import Space, block_key_sql, site_blocks
from terrane.session import Stored

TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 24    # of vectors that a task holds
SCHEMA = "idx long, y double, g double, leave double, root double, x array<double>, u array<double>"
BETWEEN = "idx long, y double, g double, leave double, root double, x binary, u binary, z binary"   # packed, on the way


def symmetric_rates(s: np.ndarray) -> np.ndarray:
    """Symmetric form of the rate of a step with scaled difference ``s``: s / (2 sinh(s / 2)), 1 at zero."""
    h = 0.5 * s
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.abs(h) < 1e-12, 1.0, h / np.sinh(h))


def step_rates(s: np.ndarray) -> np.ndarray:
    """Rate of a step: s / (1 - exp(-s)), 1 at zero."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.abs(s) < 1e-12, 1.0, s / -np.expm1(-s))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    size = 8 * width
    data = column.buffers()[2]
    values = np.frombuffer(data, np.float64, len(column) * width, column.offset * size) if size and len(column) else np.zeros(0)
    return values.reshape(len(column), width)


def packed(values: np.ndarray) -> pa.BinaryArray:
    n, width = values.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (8 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass(frozen=True)
class Shape:
    """What a task needs to know of the space and the walk."""

    radices: tuple[int, ...]
    strides: tuple[int, ...]
    ns: float
    exchange: tuple | None    # for each site, a symmetric table by allele pair

    def partial(self, block: Sequence[int], idx: np.ndarray, y: np.ndarray, g: np.ndarray, form):
        """A function that multiplies vectors by the rates between rows that differ at one site of ``block``."""
        if not block or not len(idx):
            return lambda x: np.zeros_like(x)
        sizes = [self.radices[s] for s in block]
        digits = [idx // self.strides[s] % self.radices[s] for s in block]
        rest = idx - sum(d * self.strides[s] for d, s in zip(digits, block))
        group = np.unique(rest, return_inverse=True)[1]
        place = group * prod(sizes) + np.ravel_multi_index(digits, sizes)
        cells = (int(group.max()) + 1) * prod(sizes)
        values = np.full(cells, np.nan)
        values[place] = y
        scales = np.zeros(cells)
        scales[place] = g
        kernels = []
        for k, s in enumerate(block):
            inner = prod(sizes[k + 1:])
            shape = (cells // (sizes[k] * inner), sizes[k], inner)
            here, scale = (np.moveaxis(v.reshape(shape), 1, 2) for v in (values, scales))   # ..., allele
            rates = form(self.ns * (here[..., None, :] - here[..., :, None]))
            rates = np.where(np.isnan(rates), 0.0, rates)
            if self.exchange:
                rates = rates * np.asarray(self.exchange[s])
            rates = rates * scale[..., None, :] * (scale[..., :, None] if form is symmetric_rates else scale[..., None, :])
            rates[..., np.arange(sizes[k]), np.arange(sizes[k])] = 0.0
            kernels.append((shape, rates))

        def apply(x: np.ndarray) -> np.ndarray:
            dense = np.zeros((cells, x.shape[1]))
            dense[place] = x
            out = np.zeros_like(dense)
            for shape, rates in kernels:
                v = np.moveaxis(dense.reshape(*shape, -1), 1, 2)
                out += np.moveaxis(rates @ v, 2, 1).reshape(cells, -1)
            return out[place]
        return apply


@dataclass(frozen=True)
class Step:
    """What happens to the vector block x when a product A x is complete: x, z = alpha A x + beta x + gamma z, x."""

    alpha: float
    beta: float
    gamma: float


class BlockWalk:
    """Polynomials in the symmetric form of the rate matrix, A = D^1/2 Q D^-1/2, over rows of ``SCHEMA``.

    ``g`` is the root of a state's neutral weight times the number of states (1 where all are equal), ``leave`` the rate
    out of it, ``root`` the root of its stationary frequency; ``x`` holds a row's entries of the vectors.
    """

    def __init__(self, space: Space, ns: float, exchange: Sequence | None = None):
        self.space = space
        self.shape = Shape(tuple(space.radices), tuple(space.strides), float(ns), tuple(map(tuple, exchange)) if exchange else None)
        blocks = site_blocks(space)
        self.blocks = blocks if len(blocks) == 2 else [blocks[0], []]

    def _dealt(self, df: DataFrame, block: Sequence[int], vectors: int) -> DataFrame:
        held = self.space.n * vectors * 32
        parts = max(ceil(held / TASK_BYTES), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(held / LEAST_BYTES)))
        return df.selectExpr("*", f"{block_key_sql(self.space, block)} AS _block").repartition(parts, "_block").drop("_block")

    def _stage(self, df: DataFrame, turn: int, width: int, step: Step | None, complete: bool, mix: np.ndarray | None, form) -> DataFrame:
        """Ends the product that the stage before began (if any), then begins the next one (unless ``complete``)."""
        shape, block, first = self.shape, self.blocks[turn % 2], turn == 0
        new = mix.shape[1] if mix is not None else width

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(rows)
            if not held:
                return
            t = pa.Table.from_batches(held)
            idx, y, g, leave, root = (t.column(c).to_numpy() for c in ("idx", "y", "g", "leave", "root"))
            if first:
                x = matrix(t.column("x"), width)
                if mix is not None:
                    x = np.hstack([x, root[:, None]]) @ mix
                z, u = np.zeros_like(x), np.zeros_like(x)
            else:
                x, z, u = (unpacked(t.column(c), new) for c in ("x", "z", "u"))
            apply = shape.partial(block, idx, y, g, form)
            if not first:
                u = u + apply(x) - leave[:, None] * x
                if not complete:
                    x, z = step.alpha * u + step.beta * x + step.gamma * z, x
            if not complete:
                u = apply(x)
            columns = [lists(x), lists(u)] if complete else [packed(x), packed(u), packed(z)]
            out = pa.Table.from_arrays([*[t.column(c) for c in ("idx", "y", "g", "leave", "root")], *columns],
                                       names=["idx", "y", "g", "leave", "root", "x", "u", *([] if complete else ["z"])])
            yield from out.to_batches(max_chunksize=10_000)

        return self._dealt(df, block, 3 * new).mapInArrow(batches, SCHEMA if complete else BETWEEN)

    def polynomial(self, rows: DataFrame, width: int, steps: Sequence[Step], mix: np.ndarray | None = None, form=symmetric_rates) -> DataFrame:
        """``x`` after all ``steps`` and ``u`` = A x. ``mix`` first combines the columns of (x, root); ``width`` is the length of x before."""
        df = rows.select("idx", "y", "g", "leave", "root", "x")
        df = self._stage(df, 0, width, None, False, mix, form)
        new = mix.shape[1] if mix is not None else width
        for turn, step in enumerate(steps):
            df = self._stage(df, turn + 1, new, step, False, None, form)
        return self._stage(df, len(steps) + 1, new, None, True, None, form)

    def rows(self, nodes: DataFrame, y: str = "y", p0: str | None = None) -> Stored:
        """The rows of a landscape ``(idx, y[, p0])`` with ``x`` empty; measures ``bound`` (of the spectrum) and ``n``."""
        ns = self.shape.ns
        g = F.sqrt(F.col(p0).cast("double") * F.lit(float(self.space.n))) if p0 else F.lit(1.0)
        df = nodes.select("idx", F.col(y).cast("double").alias("y"), g.alias("g"))
        top = df.agg(F.max(F.lit(ns) * F.col("y") + 2 * F.log("g"))).first()[0]
        # exp(half the log weight), normalised below
        df = df.withColumns({"leave": F.lit(0.0), "root": F.exp(0.5 * (F.lit(ns) * F.col("y") - F.lit(top))) * F.col("g"), "x": F.array(F.lit(1.0))})
        df = self.polynomial(df, 1, [], form=step_rates).withColumns({"leave": F.col("u")[0], "x": F.array(F.lit(1.0))})
        # rate out plus symmetric rates, by row: no eigenvalue of -A is larger
        df = self.polynomial(df, 1, []).select("idx", "y", "g", "leave", "root", (F.col("u")[0] + 2 * F.col("leave")).alias("radius"))
        step = Stored(df, {"total": F.sum(F.col("root") * F.col("root")), "bound": F.max("radius"), "n": F.count(F.lit(1))})
        step.table = step.table.drop("radius").withColumn("root", F.col("root") / F.lit(float(np.sqrt(step.measures["total"] or 1.0))))
        return step


def products(table: DataFrame, columns: Sequence[str], widths: Sequence[int]) -> np.ndarray:
    """Inner products of all vectors in scalar (width 0) and array columns; one row per pair and task is summed in Spark."""
    total = sum(w or 1 for w in widths)
    names = list(columns)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((total, total))
        for b in rows:
            t = pa.Table.from_batches([b])
            z = np.hstack([matrix(t.column(c), w) if w else t.column(c).to_numpy()[:, None] for c, w in zip(names, widths)])
            sums += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total, dtype=np.int32)), pa.array(sums.ravel())], names=["at", "v"])

    out = np.zeros(total * total)
    for r in table.select(*names).mapInArrow(batches, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(total, total)
