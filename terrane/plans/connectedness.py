"""Decay of the correlation at each site, fitted to the second moments of a landscape on a space of any length.

The kernel is a product over sites of 1 + (a - 1) rho on a match and 1 - rho on a mismatch. Its eigenvalue on the part
of a vector that varies at exactly the sites J is n times the product of rho over J, and the squared kernel has such
products as well. So the squared distance to all pairs y y' needs three sums over site sets,

    F(z, w) = sum over J of z_J * product of w_s over s in J,

with z_J the squared norm of that part of y or of the 0/1 marks of what was observed. The norms are one table of 2^l rows
that is written once; a step of the fit reads it once without a shuffle and the driver sees 4 (l + 1) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrane.operators.spaces import Space, block_key_sql, site_blocks
from terrane.plans import kernels as K
from terrane.plans.block_walk import LEAST_BYTES, TASK_BYTES
from terrane.plans.regression import observed
from terrane.plans.smallfit import descend
from terrane.session import cut

#: Decays per site from which the descent starts; all are carried along in the same passes.
STARTS = (0.1, 0.5, 0.9)
#: Smallest rho, so that a product without one site is a quotient.
LEAST = 1e-12


def site_contrasts(a: int) -> np.ndarray:
    """Rows are an orthonormal basis of the functions of one site with ``a`` alleles, the constant first."""
    return np.vstack([np.full(a, a ** -0.5), K.helmert(a).T])


@dataclass(frozen=True)
class Block:
    """The sites that one shuffle brings together, with the radices and strides of the space."""

    sites: tuple[int, ...]
    radices: tuple[int, ...]
    strides: tuple[int, ...]

    def turned(self, idx: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(idx, values)`` of contrasts at the sites of the block, for all states of the groups met; absent rows are zero."""
        sizes = [self.radices[s] for s in self.sites]
        steps = [self.strides[s] for s in self.sites]
        digits = [idx // step % a for a, step in zip(sizes, steps)]
        rest, group = np.unique(idx - sum(d * step for d, step in zip(digits, steps)), return_inverse=True)
        cells = prod(sizes)
        dense = np.zeros((len(rest) * cells, x.shape[1]))
        dense[group * cells + np.ravel_multi_index(digits, sizes)] = x
        for k, a in enumerate(sizes):
            dense = site_contrasts(a) @ dense.reshape(len(rest) * prod(sizes[:k]), a, -1)
        inside = sum(d * step for d, step in zip(np.unravel_index(np.arange(cells), sizes), steps))
        return (rest[:, None] + inside).ravel(), dense.reshape(len(rest) * cells, -1)

    def masks(self, idx: np.ndarray) -> np.ndarray:
        """Sites with a contrast other than the constant."""
        out = np.zeros(len(idx), dtype=np.int64)
        for a, step in zip(self.radices, self.strides):
            out = out * 2 + (idx // step % a > 0)
        return out


def site_set_norms(states: DataFrame, space: Space, columns: dict[str, str]) -> DataFrame:
    """``(mask, out...)``: squared norm of the part of each column that varies at exactly the sites of ``mask``.

    States without a row count as zero, so incomplete tables need no row for the others; masks without a row have norm zero.
    Bit ``l - 1 - s`` of the mask stands for site s. A shuffle for each of the two site blocks brings together what differs
    inside the block only, tasks turn it to contrasts as small dense arrays and sum squares by mask before the last shuffle.
    """
    names, held = list(columns), 8 * (len(columns) + 1) * space.n
    parts = max(ceil(held / TASK_BYTES), min(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(held / LEAST_BYTES)))
    rows = states.selectExpr("idx", *[f"CAST(`{v}` AS DOUBLE) AS `{v}`" for v in names])
    schema = "idx bigint, " + ", ".join(f"`{v}` double" for v in names)
    blocks = [Block(tuple(b), space.radices, space.strides) for b in site_blocks(space)]
    for n, block in enumerate(blocks):
        last = n == len(blocks) - 1

        def turn(batches: Iterator[pa.RecordBatch], block: Block = block, last: bool = last) -> Iterator[pa.RecordBatch]:
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            t = pa.Table.from_batches(batches)
            idx, x = block.turned(t["idx"].to_numpy(), np.stack([t[v].to_numpy() for v in names], axis=1))
            if last:
                idx, place = np.unique(block.masks(idx), return_inverse=True)
                x = np.stack([np.bincount(place, c * c, len(idx)) for c in x.T], axis=1)
            yield from pa.table([idx, *x.T], names=["idx", *names]).to_batches(1 << 16)

        key = f"{block_key_sql(space, block.sites)} AS _block"
        rows = rows.selectExpr("*", key).repartition(parts, "_block").drop("_block").mapInArrow(turn, schema)
    return rows.groupBy(F.col("idx").alias("mask")).agg(*[F.sum(v).alias(out) for v, out in columns.items()])


def product_sums(held: np.ndarray, z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows (F(z, w), its derivatives by every w_s) for rows ``w`` of positive factors, summed over a part of the site sets.

    ``held`` has a 0/1 row and ``z`` a number for each site set.
    """
    terms = np.exp(np.log(w) @ held.T) * z
    return np.hstack([terms.sum(1, keepdims=True), (terms @ held) / w])


class Moments:
    """The three sums for several lists of rho at once: one pass over the stored norms."""

    def __init__(self, norms: DataFrame, space: Space):
        self.norms, self.space, self.radices = cut(norms), space, np.array(space.radices, dtype=float)
        none = self.norms.where("mask = 0").first()
        self.sum, self.pairs = space.n * none["y"], space.n * none["o"]

    def squared(self, rho: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Scale and factors of the squared kernel, and the derivative of log scale and of the factors by rho."""
        a = self.radices
        match, differ = 1 + (a - 1) * rho, 1 - rho
        even, odd = match ** 2 + (a - 1) * differ ** 2, match ** 2 - differ ** 2
        d_even, d_odd = 2 * (a - 1) * (match - differ), 2 * ((a - 1) * match + differ)
        return float(np.prod(even)), odd / even, np.array([d_even / even, (d_odd * even - odd * d_even) / even ** 2])

    def forms(self, rhos: np.ndarray) -> np.ndarray:
        """Per rho the sums (y, rho), (o, rho), (o, factors of the square), each with its derivatives by the factors."""
        squares = np.array([self.squared(r)[1] for r in rhos])
        size, bits = 3 * (self.space.length + 1) * len(rhos), np.arange(self.space.length - 1, -1, -1)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, len(rhos), len(bits) + 1))
            for b in batches:
                mask, y, o = (b.column(c).to_numpy() for c in ("mask", "y", "o"))
                held = ((mask[:, None] >> bits) & 1).astype(float)
                out += [product_sums(held, y, rhos), product_sums(held, o, rhos), product_sums(held, o, squares)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out.swapaxes(0, 1).ravel())], ["k", "v"])

        found = self.norms.select("mask", "y", "o").mapInArrow(sums, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v"))
        out = np.zeros(size)
        for r in found.collect():  # 3 (l + 1) numbers for each rho asked for
            out[r["k"]] = r["v"]
        return out.reshape(len(rhos), 3, -1)

    def baseline(self, own: float) -> float:
        """Best constant beside a kernel whose sum over the observed pairs is ``own``; mu = 1 + constant stays positive."""
        return max((self.sum - own) / self.pairs, -1 + LEAST)

    def losses(self, rhos: np.ndarray) -> list[tuple[float, np.ndarray, float]]:
        """Per rho: mean of (y y' - kernel - constant)^2 over the pairs, short of the mean of (y y')^2; slope; constant."""
        out = []
        for rho, (fy, fo, fsq) in zip(rhos, self.forms(rhos)):
            n = float(self.space.n)
            scale, _, (d_scale, d_factors) = self.squared(rho)
            fits, own, square = n * fy[0], n * fo[0], scale * fsq[0]
            c = self.baseline(own)
            loss = square - 2 * fits + 2 * c * (own - self.sum) + c * c * self.pairs
            slope = scale * (fsq[0] * d_scale + fsq[1:] * d_factors) - 2 * n * fy[1:] + 2 * c * n * fo[1:]
            out.append((loss / self.pairs, slope / self.pairs, c))
        return out


def decay_to_rho(decay: np.ndarray, radices: np.ndarray) -> np.ndarray:
    """rho of a site whose covariance falls by the factor ``decay`` when it changes."""
    return np.maximum((1 - decay) / (1 + (radices - 1) * decay), LEAST)


def fit_connectedness(obs: DataFrame, space: Space, starts: tuple[float, ...] = STARTS) -> tuple[float, np.ndarray]:
    """(log mu, rho per site): least squares to y y' of all ordered pairs of observed states, replicates merged (a variance
    may be missing where there is one measurement).

    The parameters are the factors by which the covariance falls when one site changes; kernel scale and constant follow
    from them. The starts descend side by side and share each pass over the 2^l norms.
    """
    given = observed(space, obs, ["y"]).select("idx", "y", F.lit(1.0).alias("o"))
    moments = Moments(site_set_norms(given, space, {"y": "y", "o": "o"}), space)
    radices = moments.radices

    def at(many: np.ndarray) -> list[tuple[float, np.ndarray]]:
        decay = np.exp(-np.exp(many))
        rhos = decay_to_rho(decay, radices)
        by_decay = -radices / (1 + (radices - 1) * decay) ** 2
        found = moments.losses(rhos)
        # a rho at its floor no longer follows the decay
        return [(loss, np.where(rho > LEAST, slope * d * -x * np.exp(t), 0.0)) for (loss, slope, _), rho, d, x, t in zip(found, rhos, by_decay, decay, many)]

    first = np.log(-np.log(np.array(starts)))[:, None] * np.ones(space.length)
    best = descend(at, first)
    rho = decay_to_rho(np.exp(-np.exp(best)), radices)
    c = moments.losses(rho[None])[0][2]
    return float(np.log1p(c)), rho
