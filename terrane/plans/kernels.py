"""Linear maps on state vectors ``(idx, v, ...)`` of regular product spaces.

Every map here is diagonal in the interaction-order projections, so one routine computes all of
them: sites are averaged one after another inside mask groups (window sums), keeping one column
per order. All sites of a block share one shuffle, so any map costs two shuffles of n rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, factorial

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrane.functions.seqcols import total
from terrane.operators.spaces import Space, block_partition, int64, rest_digits, site_blocks


# --- eigenvalues (driver side, l + 1 numbers) ---------------------------------------------

def multiplicities(space: Space) -> np.ndarray:
    return np.array([comb(space.length, k) * (space.alpha - 1) ** k for k in range(space.length + 1)], dtype=float)


def laplacian_lambdas(space: Space) -> np.ndarray:
    return np.arange(space.length + 1, dtype=float) * space.alpha


def delta_lambdas(space: Space, p: int) -> np.ndarray:
    """Eigenvalues of the P-way epistasis operator: alpha^P * C(k, P)."""
    if not 1 <= p <= space.length:
        raise ValueError("P must be between 1 and the sequence length")
    return np.array([float(space.alpha) ** p * comb(k, p) for k in range(space.length + 1)])


def extended_delta_lambdas(space: Space, p: int, low: Sequence[float]) -> np.ndarray:
    """P-way epistasis with a proper prior (variances ``low``) on the orders below P."""
    if len(low) != p:
        raise ValueError("one variance per order below P is needed")
    out = delta_lambdas(space, p)
    out[:p] = 1.0 / np.asarray(low, dtype=float)
    return out


def n_faces(space: Space, p: int) -> float:
    """Number of P-dimensional faces (two alleles at each of P sites, fixed background)."""
    a = space.alpha
    return float(comb(space.length, p) * comb(a, 2) ** p * a ** (space.length - p))


def faces_per_state(space: Space, p: int) -> int:
    return comb(space.length, p) * (space.alpha - 1) ** p


def polynomial_lambdas(space: Space, coefficients: Sequence[float]) -> np.ndarray:
    """Eigenvalues of sum_i c_i L^i."""
    lam = laplacian_lambdas(space)
    return sum(c * lam ** i for i, c in enumerate(coefficients))


def exponential_lambdas(space: Space, t: float, order: int) -> np.ndarray:
    """Truncated series of exp(t L)."""
    return polynomial_lambdas(space, [t ** i / factorial(i) for i in range(order + 1)])


def krawtchouk(space: Space) -> np.ndarray:
    """w[k, d]: entry of the order-k projection between states at distance d."""
    l, a = space.length, space.alpha
    w = [[sum((-1) ** q * (a - 1) ** (k - q) * comb(d, q) * comb(l - d, k - q) for q in range(k + 1)) for d in range(l + 1)] for k in range(l + 1)]
    return np.array(w, dtype=float) / float(a) ** l


def distance_lambdas(space: Space, d: int) -> np.ndarray:
    """Eigenvalues of the distance-d adjacency: n * w[k, d] * C(l, d) (a-1)^d / m_k."""
    pairs = comb(space.length, d) * (space.alpha - 1) ** d
    return space.n * krawtchouk(space)[:, d] * pairs / multiplicities(space)


def kernel_diagonal(space: Space, lambdas: Sequence[float]) -> float:
    return float(np.dot(multiplicities(space), lambdas) / space.n)


def kernel_log_det(space: Space, lambdas: Sequence[float]) -> float:
    lam = np.asarray(lambdas, dtype=float)
    return float("-inf") if (lam == 0).any() else float(np.dot(multiplicities(space), np.log(lam)))


# --- applying maps -------------------------------------------------------------------------

def order_columns(vec: DataFrame, space: Space, v: str | dict[str, str] = "v", prefix: str = "_k") -> DataFrame:
    """Add the projections ``_k0.._kl`` of a complete vector; all other columns ride along.

    Several vectors, given as ``{prefix: column}``, share every shuffle.
    """
    return _projections(vec, space, v if isinstance(v, dict) else {prefix: v})


def _projections(vec: DataFrame, space: Space, columns: dict[str, str]) -> DataFrame:
    """Projections of several vectors at once (prefix -> column); they share every shuffle.

    Averaging one more site splits every column into its mean (order unchanged) and the rest (one
    order higher). Written as SQL text, which plans much faster than nested column objects.
    """
    names = [f"`{c}`" for c in vec.columns]
    out = vec.selectExpr(*names, *[f"CAST(`{v}` AS DOUBLE) AS `{p}0`" for p, v in columns.items()])
    done = 0
    for block in site_blocks(space):
        out, key = block_partition(out, space, block)
        for s in block:
            group = ", ".join([key, *[space.digit_sql(t) for t in block if t != s]])
            held = [(p, k) for p in columns for k in range(done + 1)]
            out = out.selectExpr("*", *[f"sum(`{p}{k}`) OVER (PARTITION BY {group}) / {space.alpha}D AS `_m{p}{k}`" for p, k in held])
            grown = []
            for p in columns:
                for k in range(done + 2):
                    same = [f"`_m{p}{k}`"] if k <= done else []
                    up = [f"`{p}{k - 1}` - `_m{p}{k - 1}`"] if k else []
                    grown.append(" + ".join(same + up) + f" AS `{p}{k}`")
            out = out.selectExpr(*names, key, *grown)
            done += 1
        out = out.drop(key)
    return out


def apply_kernels(vec: DataFrame, space: Space, maps: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Several ``out = sum_k lambda_k P_k v`` at once, given as ``{out: (v, lambdas)}``, in two shuffles."""
    names = {f"_k{n}_": v for n, v in enumerate(dict.fromkeys(v for v, _ in maps.values()))}
    prefix = {v: p for p, v in names.items()}
    outs = []
    for out, (v, lambdas) in maps.items():
        parts = [f"{float(x)!r}D * `{prefix[v]}{k}`" for k, x in enumerate(lambdas) if x != 0.0]
        outs.append((" + ".join(parts) or "0D") + f" AS `{out}`")
    kept = [f"`{c}`" for c in vec.columns if c not in maps]
    return _projections(vec, space, names).selectExpr(*kept, *outs)


def apply_kernel(vec: DataFrame, space: Space, lambdas: Sequence[float], v: str = "v", out: str = "u") -> DataFrame:
    """``out`` = sum_k lambda_k P_k v for a complete vector, in two shuffles."""
    return apply_kernels(vec, space, {out: (v, lambdas)})


def laplacian(vec: DataFrame, space: Space, v: str = "v", out: str = "u") -> DataFrame:
    """l * alpha * v minus the sum over every mask group; irregular spaces are fine."""
    df, sums = vec, []
    for block in site_blocks(space):
        df, key = block_partition(df, space, block)
        for s in block:
            group = W.partitionBy(key, *rest_digits(space, block, s))
            df = df.withColumn(f"_s{s}", F.sum(v).over(group))
            sums.append(F.col(f"_s{s}"))
        df = df.drop(key)
    df = df.withColumn(out, F.lit(float(sum(space.radices))) * F.col(v) - total(sums))
    return df.drop(*[f"_s{s}" for s in range(space.length)])


def delta_p(vec: DataFrame, space: Space, p: int, v: str = "v", out: str = "u") -> DataFrame:
    return apply_kernel(vec, space, delta_lambdas(space, p), v, out)


def apply_site_matrices(vec: DataFrame, space: Space, matrices: Sequence[Sequence[Sequence[float]]], v: str = "v", out: str = "u") -> DataFrame:
    """Kronecker product of one small matrix per site, applied site after site."""
    df = vec.withColumn(out, F.col(v).cast("double"))
    for block in site_blocks(space):
        df, key = block_partition(df, space, block)
        for s in block:
            group = W.partitionBy(key, *rest_digits(space, block, s))
            digit = space.digit("idx", s)
            df = df.withColumns({
                f"_b{b}": F.sum(F.when(digit == b, F.col(out)).otherwise(0.0)).over(group) for b in range(space.radices[s])
            })
            row = F.element_at(
                F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in matrices[s]]), (digit + 1).cast("int")
            )
            df = df.withColumn(out, total(row[b] * F.col(f"_b{b}") for b in range(space.radices[s])))
            df = df.drop(*[f"_b{b}" for b in range(space.radices[s])])
        df = df.drop(key)
    return df


def apply_connectedness(vec: DataFrame, space: Space, rho: Sequence[float], v: str = "v", out: str = "u", power: float = 1.0) -> DataFrame:
    """Site-factored kernel: at each site keep the mean and scale the deviation by rho."""
    df = vec.withColumn(out, F.col(v).cast("double"))
    for block in site_blocks(space):
        df, key = block_partition(df, space, block)
        for s in block:
            group = W.partitionBy(key, *rest_digits(space, block, s))
            r = float(rho[s]) ** power
            df = df.withColumn("_mean", F.sum(out).over(group) / float(space.radices[s]))
            df = df.withColumn(out, F.col("_mean") + F.lit(r) * (F.col(out) - F.col("_mean"))).drop("_mean")
        df = df.drop(key)
    return df


@dataclass(frozen=True)
class Kernel:
    """A symmetric map of state columns with its (constant) diagonal, for solvers that take any kernel.

    ``apply(df, columns, outs)`` adds one output column per column.
    """

    apply: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]
    diagonal: float


def order_kernel(space: Space, lambdas: Sequence[float]) -> Kernel:
    """Kernel with one eigenvalue per interaction order."""
    apply = lambda df, cols, outs: apply_kernels(df, space, {o: (c, lambdas) for c, o in zip(cols, outs)})
    return Kernel(apply, kernel_diagonal(space, lambdas))


def connectedness_kernel(space: Space, rho: Sequence[float], variance: float = 1.0) -> Kernel:
    """``variance`` times the product over sites of 1 + (a - 1) rho on a match and 1 - rho on a mismatch."""
    def apply(df: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
        names = [f"`{c}`" for c in df.columns if c not in outs]
        df = df.selectExpr(*names, *[f"{variance * space.n!r}D * `{c}` AS `{o}`" for c, o in zip(cols, outs)])
        for block in site_blocks(space):
            df, key = block_partition(df, space, block)
            for s in block:
                group, r = ", ".join([key, *[space.digit_sql(t) for t in block if t != s]]), float(rho[s])
                mean = lambda o: f"sum(`{o}`) OVER (PARTITION BY {group}) / {space.radices[s]}D"
                df = df.selectExpr(*names, key, *[f"{1.0 - r!r}D * ({mean(o)}) + {r!r}D * `{o}` AS `{o}`" for o in outs])
            df = df.drop(key)
        return df

    return Kernel(apply, variance * float(np.prod([1.0 + (r - 1) * x for r, x in zip(space.radices, rho)])))


def project_site_set(vec: DataFrame, space: Space, sites: Sequence[int], v: str = "v", out: str = "u") -> DataFrame:
    """Part of a vector due to exactly one set of interacting sites."""
    rho = [float("inf")] * space.length
    df = vec.withColumn(out, F.col(v).cast("double"))
    for block in site_blocks(space):
        df, key = block_partition(df, space, block)
        for s in block:
            group = W.partitionBy(key, *rest_digits(space, block, s))
            mean = F.sum(out).over(group) / float(space.radices[s])
            df = df.withColumn("_mean", mean)
            df = df.withColumn(out, F.col(out) - F.col("_mean") if s in sites else F.col("_mean")).drop("_mean")
        df = df.drop(key)
    return df


def site_set_neighbour_sum(vec: DataFrame, space: Space, sites: Sequence[int], v: str = "v", out: str = "u") -> DataFrame:
    """Sum over the states that differ at exactly the given sites."""
    matrices = []
    for s, r in enumerate(space.radices):
        matrices.append([[float((a == b) != (s in sites)) for b in range(r)] for a in range(r)])
    return apply_site_matrices(vec, space, matrices, v, out)


def distance_neighbour_sum(vec: DataFrame, space: Space, d: int, v: str = "v", out: str = "u") -> DataFrame:
    """Sum over the states at Hamming distance exactly d."""
    return apply_kernel(vec, space, distance_lambdas(space, d), v, out)


# --- sub-vectors and diagonals -----------------------------------------------------------------

def restrict(vec: DataFrame, subset: DataFrame) -> DataFrame:
    return vec.join(subset.select("idx"), "idx", "left_semi")


def scatter(space: Space, part: DataFrame, v: str = "v") -> DataFrame:
    """Zero-filled complete vector from values on a subset of the states."""
    states = part.sparkSession.range(space.n).withColumnRenamed("id", "idx")
    return states.join(part.select("idx", v), "idx", "left").withColumn(v, F.coalesce(F.col(v), F.lit(0.0)))


def scale_rows(vec: DataFrame, diagonal: DataFrame, v: str = "v", d: str = "d") -> DataFrame:
    return vec.join(diagonal.select("idx", d), "idx").withColumn(v, F.col(v) * F.col(d)).drop(d)


def inner_product(a: DataFrame, b: DataFrame, v: str = "v") -> DataFrame:
    right = b.select("idx", F.col(v).alias("_w"))
    return a.select("idx", v).join(right, "idx").agg(F.sum(F.col(v) * F.col("_w")).alias("dot"))


def quadratic_form(vec: DataFrame, space: Space, lambdas: Sequence[float], v: str = "v") -> DataFrame:
    """One row: v'Kv, v'v and their ratio."""
    applied = apply_kernel(vec, space, lambdas, v, "_u")
    return applied.agg(
        F.sum(F.col(v) * F.col("_u")).alias("quad"), F.sum(F.col(v) * F.col(v)).alias("norm2"),
        (F.sum(F.col(v) * F.col("_u")) / F.sum(F.col(v) * F.col(v))).alias("rayleigh"),
    )


# --- kernel blocks between sequence lists -------------------------------------------------------

REQUEST_BLOCK = 1000


def _against(rows: DataFrame, requested: Sequence[str], seq: str) -> DataFrame:
    """``(seq1, seq2)`` between a table and a list, block by block of the list."""
    blocks = [requested[k:k + REQUEST_BLOCK] for k in range(0, len(requested), REQUEST_BLOCK)] or [[]]
    parts = [rows.select(F.col(seq).alias("seq1"), F.explode(F.array(*[F.lit(x) for x in b]).cast("array<string>")).alias("seq2")) for b in blocks]
    return reduce(DataFrame.unionByName, parts)


def kernel_by_distance(space: Space, lambdas: Sequence[float]) -> np.ndarray:
    return krawtchouk(space).T @ np.asarray(lambdas, dtype=float)


def kernel_block(rows: DataFrame, requested: Sequence[str], cov: Sequence[float], length: int, seq: str = "seq") -> DataFrame:
    """``(seq1, seq2, k)`` between a table and a list, through the Hamming distance."""
    pairs = _against(rows, requested, seq)
    by_distance = F.array(*[F.lit(float(c)) for c in cov])
    mismatches = total((F.substring("seq1", s + 1, 1) != F.substring("seq2", s + 1, 1)).cast("int") for s in range(length))
    return pairs.withColumn("k", F.element_at(by_distance, mismatches + 1))


def connectedness_block(rows: DataFrame, requested: Sequence[str], space: Space, rho: Sequence[float], seq: str = "seq") -> DataFrame:
    """Product over sites of (1 + (a-1) rho) on a match and (1 - rho) on a mismatch, over n."""
    pairs = _against(rows, requested, seq)
    k = F.lit(1.0 / space.n)
    for s, r in enumerate(rho):
        same = F.substring("seq1", s + 1, 1) == F.substring("seq2", s + 1, 1)
        k = k * F.when(same, 1.0 + (space.radices[s] - 1) * float(r)).otherwise(1.0 - float(r))
    return pairs.withColumn("k", k)


# --- low-order basis -----------------------------------------------------------------------------

def helmert(a: int) -> np.ndarray:
    """Orthonormal contrasts of one site, (a, a-1)."""
    h = np.zeros((a, a - 1))
    for c in range(1, a):
        h[:c, c - 1] = 1.0
        h[c, c - 1] = -float(c)
        h[:, c - 1] /= np.sqrt(c * (c + 1.0))
    return h


def basis_sets(space: Space, p: int) -> list[tuple[int, ...]]:
    return [s for k in range(p) for s in combinations(range(space.length), k)]


def basis_values(space: Space, p: int) -> list[tuple[str, Column]]:
    """Named expressions of ``idx`` for all basis features of the orders below ``p``."""
    h = helmert(space.alpha)
    site_value = lambda s, c: F.element_at(F.array(*[F.lit(float(x)) for x in h[:, c]]), (space.digit("idx", s) + 1).cast("int"))
    out = []
    for sites in basis_sets(space, p):
        scale = float(space.alpha) ** (-(space.length - len(sites)) / 2.0)
        for contrast in np.ndindex(*([space.alpha - 1] * len(sites))):
            value = F.lit(scale)
            for s, c in zip(sites, contrast):
                value = value * site_value(s, c)
            out.append(("b_" + "_".join(f"{s}.{c}" for s, c in zip(sites, contrast)), value))
    return out


def to_basis(vec: DataFrame, space: Space, p: int, v: str = "v") -> DataFrame:
    """``(feature, b)``: coefficients of a state vector on the orders below ``p``."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), x.alias("x")) for n, x in basis_values(space, p)]))
    rows = vec.select(F.col(v).alias("_v"), cells.alias("c"))
    return rows.groupBy(F.col("c.feature").alias("feature")).agg(F.sum(F.col("_v") * F.col("c.x")).alias("b"))


def from_basis(space: Space, p: int, coefficients: dict[str, float], states: DataFrame, out: str = "v") -> DataFrame:
    """State vector of basis coefficients, as one arithmetic expression of ``idx``."""
    parts = [F.lit(float(coefficients.get(n, 0.0))) * x for n, x in basis_values(space, p)]
    return states.withColumn(out, total(parts))
