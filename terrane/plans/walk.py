"""Random walks on landscapes: stationary frequencies, rates, jump chains, neutral models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from terrane.constants import DNA
from terrane.functions.seqcols import total
from terrane.operators.ranking import percentile
from terrane.operators.spaces import Space
from terrane.operators.stats import softmax


def log_weight(ns: float, y: str = "y", p0: str | None = None) -> Column:
    if ns < 0:
        raise ValueError("Ns must be non-negative")
    w = F.lit(float(ns)) * F.col(y)
    return w + F.log(p0) if p0 else w


def stationary_frequencies(nodes: DataFrame, ns: float, y: str = "y", p0: str | None = None, out: str = "p") -> DataFrame:
    """Frequencies proportional to p0 exp(Ns y), normalised in log space."""
    return softmax(nodes.withColumn("_s", log_weight(ns, y, p0)), "_s", out).drop("_s")


def stationary_sweep(nodes: DataFrame, ns_values: Sequence[float], y: str = "y") -> DataFrame:
    """``(ns, mean_function)`` for many Ns in one aggregation."""
    peak = nodes.agg(F.max(y)).scalar()
    grid = nodes.select(y, F.explode(F.array(*[F.lit(float(v)) for v in ns_values])).alias("ns"))
    w = F.exp(F.col("ns") * (F.col(y) - peak))
    return grid.groupBy("ns").agg((F.sum(w * F.col(y)) / F.sum(w)).alias("mean_function"))


def calibrate_ns(nodes: DataFrame, mean_function: float | None = None, perc: float | None = None, y: str = "y",
                 p0: str | None = None, tol: float = 1e-4, rtol: float = 1e-10) -> float:
    """Ns whose stationary mean equals a target value or percentile.

    The mean grows with Ns and its slope is the variance, so a bracketed Newton step needs one
    aggregate over the states.
    """
    if perc is not None:
        if not 0 < perc < 100:
            raise ValueError("the percentile must lie between 0 and 100")
        mean_function = percentile(nodes, y, perc)
    base = F.col(p0) if p0 else F.lit(1.0)
    v = F.col(y)
    neutral, top = nodes.agg(F.sum(base * v) / F.sum(base), F.max(v)).first()
    if not neutral - tol <= mean_function < top:
        raise ValueError(f"the target must lie between the neutral mean {neutral} and the maximum {top}")
    if abs(neutral - mean_function) <= tol:
        return 0.0
    low, high, ns = 0.0, float("inf"), 0.0
    for _ in range(200):
        w = base * F.exp(F.lit(ns) * (v - F.lit(top)))
        m, m2 = nodes.agg(F.sum(w * v) / F.sum(w), F.sum(w * v * v) / F.sum(w)).first()
        if abs(m - mean_function) <= rtol * max(abs(top - neutral), 1e-300):
            return ns
        low, high = (ns, high) if m < mean_function else (low, ns)
        slope = m2 - m * m
        ns = ns + (mean_function - m) / slope if slope > 0 else 2 * ns + 1
        if not low < ns < high:
            ns = (low + high) / 2 if high < float("inf") else 2 * low + 1
        if high < float("inf") and high - low <= 1e-14 * high:  # the bracket cannot shrink further
            return ns
    raise RuntimeError("no convergence in 200 steps")


# --- rates ----------------------------------------------------------------------------------

def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Node columns at both ends of the edges, as ``<c>_i`` and ``<c>_j``."""
    side = lambda k: nodes.select(F.col("idx").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return edges.join(side("i"), "i").join(side("j"), "j")


def transition_rates(nodes: DataFrame, edges: DataFrame, ns: float, n: int, y: str = "y", p0: str | None = None, exchange: str | None = None) -> DataFrame:
    """``(i, j, sym, rate)``: symmetric form D^{1/2} Q D^{-1/2} and Q itself, off the diagonal."""
    e = with_ends(edges, nodes, [y] + ([p0] if p0 else []))
    dy = F.col(f"{y}_j") - F.col(f"{y}_i")
    s = F.lit(float(ns)) * dy
    flat = (F.lit(float(ns)) == 0) | (F.abs(dy) <= 1e-8) | (s == 0)
    sym = F.when(flat, 1.0).otherwise(s / (F.exp(0.5 * s) - F.exp(-0.5 * s)))
    rate = F.when(flat, 1.0).otherwise(s / (-F.expm1(-s)))
    if p0:
        sym = sym * F.sqrt(F.col(f"{p0}_i") * F.col(f"{p0}_j")) * float(n)
        rate = rate * F.col(f"{p0}_j") * float(n)
    if exchange:
        sym, rate = sym * F.col(exchange), rate * F.col(exchange)
    return e.select("i", "j", sym.alias("sym"), rate.alias("rate"))


def leaving_rates(rates: DataFrame) -> DataFrame:
    """``(idx, leave)``: minus the diagonal of Q."""
    return rates.groupBy(F.col("i").alias("idx")).agg(F.sum("rate").alias("leave"))


def with_diagonal(rates: DataFrame) -> DataFrame:
    """All entries ``(i, j, rate)`` of Q."""
    diagonal = leaving_rates(rates).select(F.col("idx").alias("i"), F.col("idx").alias("j"), (-F.col("leave")).alias("rate"))
    return rates.select("i", "j", "rate").unionByName(diagonal)


def jump_chain(rates: DataFrame, states: DataFrame) -> DataFrame:
    """``(i, j, p)``: rates over their row sum; states without a way out stay where they are."""
    live = rates.where("rate <> 0 and i <> j")
    leave = leaving_rates(live).withColumnRenamed("idx", "i")
    moves = live.join(leave, "i").select("i", "j", (F.col("rate") / F.col("leave")).alias("p"))
    stuck = states.select(F.col("idx").alias("i")).join(leave.select("i"), "i", "left_anti")
    return moves.unionByName(stuck.select("i", F.col("i").alias("j"), F.lit(1.0).alias("p")))


def backward_rates(rates: DataFrame, nodes: DataFrame, p: str = "p") -> DataFrame:
    """Time-reversed rates: pi_j Q_ji / pi_i."""
    flipped = rates.select(F.col("j").alias("i"), F.col("i").alias("j"), "rate")
    e = with_ends(flipped, nodes, [p])
    return e.select("i", "j", (F.col("rate") * F.col(f"{p}_j") / F.col(f"{p}_i")).alias("rate"))


# --- neutral models ----------------------------------------------------------------------------

def neutral_frequencies(space: Space, freqs: Sequence[Sequence[float]] | None = None, idx: str = "idx") -> Column:
    """Product over sites of allele frequencies, as an expression of the state index."""
    out = F.lit(1.0)
    for s, r in enumerate(space.radices):
        f = freqs[s] if freqs else [1.0 / r] * r
        out = out * F.element_at(F.array(*[F.lit(float(x)) for x in f]), (space.digit(idx, s) + 1).cast("int"))
    return out


def neutral_edges(spark, space: Space, exchange: Sequence[Sequence[float]] | None = None, freqs: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """``(i, j, exchange, rate)``: exchange rates by site and allele pair, and neutral rates."""
    e = space.expand_neighbours(spark.range(space.n).withColumnRenamed("id", "i"), "i")
    tables = []
    for s, r in enumerate(space.radices):
        values = exchange[s] if exchange else [1.0] * (r * (r - 1) // 2)
        full = [[0.0] * r for _ in range(r)]
        for x, (a, b) in zip(values, combinations(range(r), 2)):
            full[a][b] = full[b][a] = float(x)
        tables.append(F.array(*[F.array(*[F.lit(x) for x in row]) for row in full]))
    site = F.element_at(F.array(*tables), F.col("site") + 1)
    x = site[F.col("a").cast("int")][F.col("b").cast("int")]
    return e.select("i", "j", x.alias("exchange"), (x * neutral_frequencies(space, freqs, "j")).alias("rate"))


# --- fixed values: which rate each DNA model gives to AC, AG, AT, CG, CT, GT ---------------------
DNA_MODELS = {
    "F81": "111111",
    "K80": "abaaba",
    "HKY85": "abaaba",
    "K81": "abccba",
    "TN93": "abaaea",
    "SYM": "abcdef",
    "GTR": "abcdef",
}
UNIFORM_MODELS = ("K80", "K81", "SYM")


def dna_model(model: str, length: int, freqs: Mapping[str, float] | None = None, rates: Mapping[str, float] | None = None) -> tuple[list, list]:
    """(site frequencies, site exchange rates) of a named nucleotide substitution model."""
    if model not in DNA_MODELS:
        raise ValueError(f"model {model} not supported, choose from {sorted(DNA_MODELS)}")
    parameters = {"1": 1.0, **{k: 1.0 for k in "abcdef"}, **(rates or {})}
    site = [0.25] * 4 if model in UNIFORM_MODELS or not freqs else [float(freqs[a]) for a in DNA]
    if abs(sum(site) - 1.0) > 1e-9:
        raise ValueError("stationary frequencies must add up to 1")
    return [site] * length, [[float(parameters[k]) for k in DNA_MODELS[model]]] * length
