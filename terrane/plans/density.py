"""Sequence density estimation: a field phi with probabilities exp(-phi), kept smooth by a P-way
epistasis penalty. Several problems (folds) are fitted together as columns of one state table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import lgamma as log_gamma

import numpy as np
from pyspark.sql import DataFrame, functions as F

from terrane.constants import MAX_EXPONENT
from terrane.functions.seqcols import expected_logp
from terrane.functions.special import lgamma
from terrane.operators.spaces import Space
from terrane.operators.splits import assign_folds
from terrane.operators.stats import geodesic, softmax
from terrane.plans import kernels as K
from terrane.plans.regression import precision_contrasts
from terrane.plans.solvers import Chain, conjugate_gradient, dot, num
from terrane.session import cut

INF = float("inf")
# fixed values: range in which the field is free, and its quadratic bound outside
PHI_LOW, PHI_HIGH = 0.0, 100.0
# decades by which the range of a scale grid is widened at most, and by how many with one fit
WIDER, BATCH = 12, 4
#: Fields that are fitted together by a cross-validation.
FIT_COLUMNS = 30


@dataclass(frozen=True)
class Prior:
    """Penalty a/s on P-way epistasis; ``low`` gives inverse variances of the orders below P."""

    p: int
    a: float
    low: tuple[float, ...] | None = None

    def lambdas(self, space: Space) -> np.ndarray:
        """Penalty of each order; at a = infinity only that of the orders below P, the others are shut."""
        lam = (0.0 if self.a == INF else self.a) / K.n_faces(space, self.p) * K.delta_lambdas(space, self.p)
        if self.low is not None:
            if len(self.low) != self.p:
                raise ValueError("one inverse variance per order below P is needed")
            lam[:self.p] = self.low
        return lam

    def open_orders(self, space: Space) -> np.ndarray:
        """1 for the orders the field may have."""
        return (np.arange(space.length + 1) < (self.p if self.a == INF else space.length + 1)).astype(float)


def density_states(space: Space, counts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``(idx, c, off)``: counts on all states and the baseline field (zero without one)."""
    own = counts.select(space.idx_or_fail("seq").alias("idx"), F.col("y").cast("double").alias("c"))
    own = own.groupBy("idx").agg(F.sum("c").alias("c"))
    states = counts.sparkSession.range(space.n).withColumnRenamed("id", "idx")
    out = states.join(own, "idx", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    if baseline is None:
        return out.withColumn("off", F.lit(0.0))
    field = baseline.select(space.idx_or_fail("seq").alias("idx"), F.col("phi").cast("double").alias("off"))
    missing = F.raise_error(F.lit("the baseline must cover every state")).cast("double")
    return out.join(field, "idx", "left").withColumn("off", F.coalesce("off", missing))


def data_terms(phi: str, c: str, n: float) -> tuple[str, str, str]:
    """Loss, gradient and curvature of the likelihood and the bound penalty at one state (SQL text)."""
    over = f"(greatest({phi} - {num(PHI_HIGH)}, 0D) + least({phi} - {num(PHI_LOW)}, 0D))"
    e = f"{num(n)} * exp(least(-({phi}), {num(MAX_EXPONENT)}))"
    return f"{c} * ({phi}) + {e} + {over} * {over}", f"{c} - {e} + 2D * {over}", f"{e} + IF({over} <> 0D, 2D, 0D)"


def fit_fields(states: DataFrame, space: Space, problems: Sequence[tuple[str, float, Prior]], start: Sequence[str] | None = None,
               rtol: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """MAP fields for problems ``(count column, total, prior)`` with a > 0: adds ``phi_<c>``.

    Newton steps whose linear systems are solved for all problems at once by conjugate gradients; the step
    lengths of a backtracking search come from one aggregate. At a = infinity gradients and curvature products are
    projected on the orders below P, which is the maximum-entropy limit. Only scalars reach the driver.
    """
    names = [c for c, _, _ in problems]
    lam = {c: prior.lambdas(space) for c, _, prior in problems}
    orders = {c: prior.open_orders(space) for c, _, prior in problems}
    totals = {c: n for c, n, _ in problems}
    shut = {c: not orders[c].all() for c in names}
    diag = {c: K.kernel_diagonal(space, lam[c]) for c in names}
    phi = {c: f"phi_{c}" for c in names}
    base = [c for c in states.columns if c not in phi.values()]
    first = start or [None] * len(names)
    df = states.withColumns({phi[c]: F.col(s) if s else F.lit(float(np.log(space.n))) for c, s in zip(names, first)})
    lengths = [1.0, 0.5, 0.25, 0.125, 0.03125, 0.0078125, 0.0009765625]
    chain, norm0 = Chain(), None
    for _ in range(max_steps):
        terms = {c: data_terms(f"{phi[c]} + off", c, totals[c]) for c in names}
        df = df.selectExpr("*", *[f"{terms[c][1]} AS dg_{c}" for c in names], *[f"{terms[c][2]} AS h_{c}" for c in names])
        df = K.apply_kernels(df, space, {**{f"cphi_{c}": (phi[c], lam[c]) for c in names}, **{f"pg_{c}": (f"dg_{c}", orders[c]) for c in names if shut[c]}})
        df = df.selectExpr("*", *[f"-(cphi_{c} + {'pg' if shut[c] else 'dg'}_{c}) AS g_{c}" for c in names])
        df, m = chain.store(df, {f"n_{c}": dot(f"g_{c}", f"g_{c}") for c in names})
        norms = [float(np.sqrt(m[f"n_{c}"])) for c in names]
        norm0 = norm0 or [max(x, 1e-300) for x in norms]
        if all(x <= rtol * max(y, totals[c] * 1e-3) for x, y, c in zip(norms, norm0, names)):
            return df.select(*base, *phi.values())
        forcing = min(0.1, max(max(x / y for x, y in zip(norms, norm0)), 1e-3))

        def apply(v: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
            held = [f"`{c}`" for c in v.columns]
            v = v.selectExpr(*held, *[f"h_{c} * `{k}` AS `_h{o}`" for c, k, o in zip(names, cols, outs)])
            maps = {o: (k, lam[c]) for c, k, o in zip(names, cols, outs)}
            maps |= {f"_p{o}": (f"_h{o}", orders[c]) for c, o in zip(names, outs) if shut[c]}
            v = K.apply_kernels(v, space, maps)
            return v.selectExpr(*held, *[f"`{o}` + `{'_p' if shut[c] else '_h'}{o}` AS `{o}`" for c, o in zip(names, outs)])

        precondition = ["1D" if shut[c] else f"h_{c} + {num(diag[c])}" for c in names]
        solved = conjugate_gradient(df, apply, [f"g_{c}" for c in names], precondition, forcing)
        d = {c: f"x_g_{c}" for c in names}
        # the quadratic part along the step needs only scalars: C d = g - h d up to the CG residual
        solved = K.apply_kernels(solved, space, {f"cd_{c}": (d[c], lam[c]) for c in names})
        probes = {}
        for c in names:
            for i, t in enumerate([0.0, *lengths]):
                moved = f"{phi[c]} + {num(t)} * {d[c]} + off"
                probes[f"f{i}_{c}"] = F.expr(f"sum({data_terms(moved, c, totals[c])[0]})")
            probes |= {f"pc_{c}": dot(d[c], f"cphi_{c}"), f"dd_{c}": dot(d[c], f"cd_{c}"), f"gd_{c}": dot(d[c], f"g_{c}")}
        solved, m = chain.store(solved, probes)
        step = {}
        for c, x, y in zip(names, norms, norm0):
            change = lambda i, t: m[f"f{i}_{c}"] - m[f"f0_{c}"] + t * m[f"pc_{c}"] + 0.5 * t * t * m[f"dd_{c}"]
            slack = 1e-12 * abs(m[f"f0_{c}"])
            step[c] = next((t for i, t in enumerate(lengths, 1) if change(i, t) <= -1e-4 * t * m[f"gd_{c}"] + slack), 0.0)
        if not any(step.values()):
            break
        df = solved.selectExpr(*base, *[f"{phi[c]} + {num(step[c])} * {d[c]} AS {phi[c]}" for c in names])
    raise RuntimeError(f"the fields did not converge: gradients {norms}, tolerance {rtol}")


def fit_field(states: DataFrame, space: Space, prior: Prior, c: str = "c", start: str | None = None, rtol: float = 1e-7) -> DataFrame:
    """Any a: the data themselves at 0, the maximum-entropy limit at infinity, MAP between."""
    n = float(states.agg(F.sum(c)).first()[0])
    if prior.a == 0:
        share = F.col(c) / F.lit(n)
        return states.withColumn(f"phi_{c}", F.when(share > 0, -F.log(share)).otherwise(F.lit(INF)))
    if start is None and prior.a != INF:
        # the field without high orders is close to the solution
        start = "_warm"
        limit = Prior(prior.p, INF, prior.low)
        states = cut(fit_fields(states, space, [(c, n, limit)], None, 1e-4).withColumnRenamed(f"phi_{c}", start))
    return cut(fit_fields(states, space, [(c, n, prior)], [start] if start else None, rtol).drop("_warm"))


# --- outputs ----------------------------------------------------------------------------------------

def density_table(fitted: DataFrame, space: Space, c: str = "c", allele_freqs: dict[str, float] | None = None) -> DataFrame:
    """``(idx, seq, frequency, phi, Q_star[, Q_adj])``; Q_adj divides by the expected allele product."""
    n = fitted.agg(F.sum(c)).scalar()
    out = fitted.select("idx", space.seq_of("idx").alias("seq"), (F.col(c) / n).alias("frequency"), F.col(f"phi_{c}").alias("phi"), "off")
    out = softmax(out.withColumn("_l", -(F.col("phi") + F.col("off"))), "_l", "Q_star")
    if allele_freqs is not None:
        out = out.withColumn("_l", F.log("Q_star") - expected_logp("seq", allele_freqs, space.length))
        return softmax(out, "_l", "Q_adj").drop("_l", "off")
    return out.drop("_l", "off")


def density_contrasts(fitted: DataFrame, space: Space, prior: Prior, contrasts: DataFrame, c: str = "c", rtol: float = 1e-9) -> DataFrame:
    """Contrasts of the field under its Laplace posterior (C + curvature)^-1."""
    n = float(fitted.agg(F.sum(c)).first()[0])
    states = fitted.selectExpr("idx", f"{data_terms(f'phi_{c} + off', c, n)[2]} AS h", f"phi_{c} AS phi")
    return precision_contrasts(states, space, prior.lambdas(space), "h", "phi", contrasts, rtol)


def field_distance(a: DataFrame, b: DataFrame, field: str = "phi_c") -> float:
    """Geodesic distance between the distributions of two fields."""
    q = lambda df: softmax(df.select("idx", (-F.col(field)).alias("_l")), "_l", "q")
    return float(geodesic(q(a), q(b)).first().geodesic)


def scale_grid(states: DataFrame, space: Space, p: int, n: int = 20, tolerance: float = 0.1, decades: tuple[float, float] = (-8.0, 4.0),
               low: tuple[float, ...] | None = None, rtol: float = 1e-6) -> list[float]:
    """0, ``n`` scales evenly spaced on the log scale, and infinity.

    The first scale is about the largest whose density lies within ``tolerance`` of the data, the last about the smallest
    within ``tolerance`` of the limit (geodesic distances). Both distances are monotone in the scale, so a batch
    of scales over ``decades`` (of the number of faces) brackets each end, and a last batch halves its way in. The
    scales of a batch are columns of one fit. Large samples need larger scales: an end that ``decades`` do not reach is
    followed decade by decade, and raises a ValueError if it is not met within ``WIDER`` more.
    """
    total_ = float(states.agg(F.sum("c")).first()[0])
    limit = cut(fit_fields(states, space, [("c", total_, Prior(p, INF, low))], None, rtol).withColumnRenamed("phi_c", "limit"))
    per_face = K.n_faces(space, p)

    def distances(logs: Sequence[float]) -> list[tuple[float, float]]:
        """(to the data, to the limit) for scales 10^x times the number of faces."""
        names = [f"c{i}" for i in range(len(logs))]
        wide = limit.withColumns({c: F.col("c") for c in names})
        fitted = cut(fit_fields(wide, space, [(c, total_, Prior(p, per_face * 10.0 ** x, low)) for c, x in zip(names, logs)], ["limit"] * len(names), rtol))
        # sums of exp(-phi) first, then the overlaps of the normalised densities
        field = lambda v: F.exp(-(F.col(v) + F.col("off")))
        norm = fitted.agg(*[F.sum(field(v)).alias(v) for v in ["limit", *[f"phi_{c}" for c in names]]]).first()
        q = {v: field(v) / F.lit(norm[v]) for v in norm.asDict()}
        overlap = fitted.agg(*[F.sum(F.sqrt(q[f"phi_{c}"] * other)).alias(f"{c}_{k}") for c in names for k, other in (("data", F.col("c") / total_), ("limit", q["limit"]))]).first()
        return [tuple(2.0 * float(np.arccos(min(1.0, overlap[f"{c}_{k}"]))) for k in ("data", "limit")) for c in names]

    coarse = np.linspace(*decades, 5).tolist()
    found = distances(coarse)
    for _ in range(0, WIDER, BATCH):
        below = [] if any(x <= tolerance for x, _ in found) else [coarse[0] - k for k in range(BATCH, 0, -1)]
        above = [] if any(x <= tolerance for _, x in found) else [coarse[-1] + k for k in range(1, BATCH + 1)]
        if not below and not above:
            break
        more = distances([*below, *above])
        coarse, found = [*below, *coarse, *above], [*more[:len(below)], *found, *more[len(below):]]
    if min(x for x, _ in found) > tolerance or min(x for _, x in found) > tolerance:
        raise ValueError(f"no scale within {tolerance} of the data and of the limit between 1e{coarse[0]:g} and 1e{coarse[-1]:g} a face: distances {found[0][0]:.3g}, {found[-1][1]:.3g}")
    near_data = max(i for i, (x, _) in enumerate(found) if x <= tolerance)
    near_limit = min(i for i, (_, x) in enumerate(found) if x <= tolerance)
    inner = [*np.linspace(coarse[near_data], coarse[min(near_data + 1, len(coarse) - 1)], 5)[1:-1], *np.linspace(coarse[max(near_limit - 1, 0)], coarse[near_limit], 5)[1:-1]]
    found = distances(inner)
    bottom = max([x for x, (d, _) in zip(inner[:3], found[:3]) if d <= tolerance], default=coarse[near_data])
    top = min([x for x, (_, d) in zip(inner[3:], found[3:]) if d <= tolerance], default=coarse[near_limit])
    if top <= bottom:
        bottom, top = coarse[0], coarse[-1]
    return [0.0, *(per_face * 10.0 ** np.linspace(bottom, top, n)).tolist(), INF]


def cross_validate_density(obs: DataFrame, space: Space, p: int, a_values: Sequence[float] | None = None, folds: int = 5, seed: int = 0,
                           weight: str = "y", low: tuple[float, ...] | None = None, rtol: float = 1e-6) -> list[tuple]:
    """``(a, fold, logL)`` of held-out sequences; folds and scales are columns of one fit, up to ``FIT_COLUMNS``.

    ``obs`` holds one row per observed sequence (``row_id``, ``seq``, weight). The limit a = infinity
    comes first and starts all other fits. Without ``a_values`` the scales are those of ``scale_grid`` on all rows.
    """
    folded = assign_folds(obs, folds, seed, "row_id")
    w = F.col(weight).cast("double")
    per_state = folded.groupBy(space.idx_or_fail("seq").alias("idx")).agg(
        *[F.sum(F.when(F.col("fold").eqNullSafe(F.lit(k)), 0.0).otherwise(w)).alias(f"train{k}") for k in range(folds)],
        *[F.sum(F.when(F.col("fold") == k, w).otherwise(0.0)).alias(f"test{k}") for k in range(folds)], F.sum(w).alias("c"),
    )
    names, warm = [f"train{k}" for k in range(folds)], [f"warm{k}" for k in range(folds)]
    cols = [*names, *[f"test{k}" for k in range(folds)], "c"]
    states = obs.sparkSession.range(space.n).withColumnRenamed("id", "idx").join(per_state, "idx", "left").na.fill(0.0, cols)
    states = cut(states.withColumn("off", F.lit(0.0)))
    if a_values is None:
        a_values = scale_grid(states.select("idx", "c", "off"), space, p, low=low, rtol=rtol)
    totals = states.agg(*[F.sum(c).alias(c) for c in names]).first()
    states = fit_fields(states, space, [(c, totals[c], Prior(p, INF, low)) for c in names], None, rtol)
    states = cut(states.withColumnsRenamed({f"phi_{c}": w for c, w in zip(names, warm)}))
    between = sorted({float(a) for a in a_values if 0 < a < INF}, reverse=True)
    size = max(1, FIT_COLUMNS // folds)
    rows, constants = [], _multinomial_constants(states, folds)
    if INF in a_values:
        rows += _held_out(states, constants, [(INF, k, F.col(warm[k])) for k in range(folds)])
    for at in range(0, len(between), size):
        problems = [(f"c{i}_{k}", a, k) for i, a in enumerate(between[at:at + size]) for k in range(folds)]
        wide = states.withColumns({c: F.col(names[k]) for c, _, k in problems})
        fitted = cut(fit_fields(wide, space, [(c, totals[names[k]], Prior(p, a, low)) for c, a, k in problems], [warm[k] for _, _, k in problems], rtol))
        rows += _held_out(fitted, constants, [(a, k, F.col(f"phi_{c}")) for c, a, k in problems])
    if 0 in a_values:
        share = lambda k: F.col(names[k]) / F.lit(totals[names[k]])
        rows += _held_out(states, constants, [(0.0, k, F.when(share(k) > 0, -F.log(share(k))).otherwise(F.lit(INF))) for k in range(folds)])
    return rows


def _held_out(fitted: DataFrame, constants: dict[int, float], fields: Sequence[tuple]) -> list[tuple]:
    """``(a, fold, logL)`` of the test counts of a fold under a field, for ``(a, fold, field)``; two aggregates for all."""
    norm = fitted.agg(*[F.log(F.sum(F.exp(-field))).alias(f"n{i}") for i, (_, _, field) in enumerate(fields)]).first()
    found = fitted.agg(*[F.sum(F.when(F.col(f"test{k}") > 0, -F.col(f"test{k}") * (field + F.lit(norm[f"n{i}"]))).otherwise(0.0)).alias(f"f{i}")
                         for i, (_, k, field) in enumerate(fields)]).first()
    return [(float(a), k, found[f"f{i}"] + constants[k]) for i, (a, k, _) in enumerate(fields)]


def _multinomial_constants(states: DataFrame, folds: int) -> dict[int, float]:
    """lnGamma(N + 1) minus the sum of lnGamma(c + 1) over the test counts of each fold."""
    each = states.select(F.inline(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"test{k}").alias("c")) for k in range(folds)])))
    distinct = each.groupBy("fold", "c").agg(F.count("*").alias("m"))
    distinct = distinct.select("fold", (F.col("m") * F.col("c")).alias("n"), (F.col("m") * lgamma(F.col("c") + 1.0)).alias("g"))
    rows = distinct.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()
    return {r.fold: log_gamma(r.n + 1.0) - r.g for r in rows}


def best_scale(rows: Sequence[tuple]) -> float:
    """Scale with the largest mean held-out log-likelihood."""
    by_a: dict[float, list[float]] = {}
    for a, _, logl in rows:
        by_a.setdefault(a, []).append(logl)
    return max(sorted(by_a), key=lambda a: float(np.mean(by_a[a])))
