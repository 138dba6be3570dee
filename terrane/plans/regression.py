"""Regression on landscapes: interpolation, variance components, Gaussian-process posteriors."""

from __future__ import annotations

from collections.abc import Sequence
from math import log10

import numpy as np
from pyspark.sql import DataFrame, functions as F

from terrane.operators.cube import covariance_by_fold, covariance_on_space, local_epistasis
from terrane.operators.replicates import merge_replicates
from terrane.operators.spaces import Space
from terrane.operators.splits import assign_folds
from terrane.operators.stats import metrics, with_interval
from terrane.plans import kernels as K, space_solve
from terrane.plans.smallfit import damped_least_squares, nonnegative_least_squares
from terrane.plans.solvers import Apply, conjugate_gradient, num
from terrane.session import cut, small_rows

#: Right-hand sides that share one block solve; longer requests take several.
BLOCK_COLUMNS = 32


def observed(space: Space, obs: DataFrame, checked: Sequence[str] = ("y", "y_var")) -> DataFrame:
    """``(idx, y[, y_var])`` of the observed states; rejects nulls and NaN in ``checked`` at run time, merges replicates."""
    obs = without_missing(obs, checked)
    named = obs if "idx" in obs.columns else obs.withColumn("idx", space.idx_or_fail("seq"))
    return merge_replicates(named, ["idx"])


def without_missing(obs: DataFrame, checked: Sequence[str] = ("y", "y_var")) -> DataFrame:
    """``obs``, with null and NaN in ``checked`` stopping the job."""
    for c in checked:
        if c in obs.columns:
            bad = F.col(c).isNull() | F.isnan(c)
            obs = obs.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} holds a missing value")).cast("double")).otherwise(F.col(c)))
    return obs


def observed_states(space: Space, obs: DataFrame) -> DataFrame:
    """``(idx, y, y_var, known)`` of the whole space, zero where nothing was observed."""
    given = observed(space, obs)
    if "y_var" not in given.columns:
        given = given.withColumn("y_var", F.lit(0.0))
    states = obs.sparkSession.range(space.n).withColumnRenamed("id", "idx")
    full = states.join(given.withColumn("known", F.lit(True)), "idx", "left")
    return full.withColumns({"known": F.coalesce("known", F.lit(False)), "y": F.coalesce("y", F.lit(0.0)), "y_var": F.coalesce("y_var", F.lit(0.0))})


def named_states(space: Space, df: DataFrame, *columns: str) -> DataFrame:
    return df.select("idx", space.seq_of("idx").alias("seq"), *columns)


# --- minimum epistasis ---------------------------------------------------------------------

def interpolate(obs: DataFrame, space: Space, p: int = 2, smooth: bool = False, rtol: float = 1e-10, precision: Apply | None = None) -> DataFrame:
    """``(idx, seq, y)``: observed values kept, the rest filled in with the least P-way epistasis.

    ``precision`` replaces the epistasis operator by any symmetric map of state columns.
    """
    lam = K.delta_lambdas(space, p)
    given = cut(observed_states(space, obs))
    free = lambda c: F.when(F.col("known"), 0.0).otherwise(F.col(c))
    epistasis = lambda df, cols, outs: K.apply_kernels(df, space, {o: (c, lam) for c, o in zip(cols, outs)})
    operator = precision or epistasis
    system = operator(given, ["y"], ["_c"]).withColumn("b", -free("_c")).select("idx", "y", "known", "b")

    def apply(df: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
        return operator(df, cols, outs).withColumns({o: free(o) for o in outs})

    if precision is None:
        solved = space_solve.solve(cut(system), space, [lam], ["b"], "0D", "NOT known", rtol)
    else:
        solved = conjugate_gradient(system, apply, ["b"], rtol=rtol)
    out = solved.select("idx", F.when(F.col("known"), F.col("y")).otherwise(F.col("x_b")).alias("y"))
    if smooth:
        out = K.apply_kernel(out, space, 1.0 - lam / K.faces_per_state(space, p), "y", "z").select("idx", F.col("z").alias("y"))
    return named_states(space, out, "y")


def delta_rank(space: Space, p: int) -> float:
    return float(K.multiplicities(space)[p:].sum())


def epistasis_scale(obs: DataFrame, space: Space, p: int) -> float:
    """Prior strength matching the mean squared P-way coefficient of the data."""
    r = local_epistasis(obs, space.length, p).first()
    return delta_rank(space, p) * r.n / r.s


def precision_solve(states: DataFrame, space: Space, prior: Prior | Sequence[Sequence[float]], weight: str | Sequence[str], rhs: Sequence[str], rtol: float = 1e-9) -> DataFrame:
    """Solve (C + diag(weight)) x = b for each column ``b`` of ``rhs``: adds ``x_<b>``.

    C is given by its eigenvalues, one list for all right-hand sides or one list for each, or as any map. Right-hand
    sides may have weights of their own as well.
    """
    weights = [weight] * len(rhs) if isinstance(weight, str) else list(weight)
    if not isinstance(prior, K.Kernel):
        own = list(prior) if np.ndim(prior[0]) else [prior] * len(rhs)
        return space_solve.solve(states, space, own, rhs, [f"`{w}`" for w in weights], rtol=rtol)

    def apply(df: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
        held = [f"`{c}`" for c in df.columns]
        return prior.apply(df, cols, outs).selectExpr(*held, *[f"`{o}` + `{w}` * `{c}` AS `{o}`" for c, o, w in zip(cols, outs, weights)])

    return conjugate_gradient(states, apply, list(rhs), [f"`{w}` + {num(prior.diagonal)}" for w in weights], rtol)


def epistasis_regression(obs: DataFrame, space: Space, p: int, a: float | None = None, rtol: float = 1e-9, precision: K.Kernel | None = None) -> DataFrame:
    """``(idx, seq, y)``: posterior mean under the prior a/s times the P-way epistasis, or under any ``precision`` map."""
    states = cut(_weighted(space, obs))
    if precision is None:
        a = epistasis_scale(obs, space, p) if a is None else a
        precision = a / K.n_faces(space, p) * K.delta_lambdas(space, p)
    solved = precision_solve(states, space, precision, "w", ["b"], rtol)
    return named_states(space, solved.select("idx", F.col("x_b").alias("y")), "y")


def _weighted(space: Space, obs: DataFrame) -> DataFrame:
    """States with weight 1 / y_var and right-hand side y / y_var (zero where unobserved)."""
    s = observed_states(space, obs)
    w = F.when(F.col("known"), 1.0 / F.when(F.col("known"), F.col("y_var")).otherwise(1.0)).otherwise(0.0)
    return s.select("idx", w.alias("w"), (w * F.col("y")).alias("b"))


def _weight_blocks(contrasts: DataFrame, space: Space) -> list[tuple[list[str], DataFrame]]:
    """``(names, (idx, w0..))`` for each block of contrasts: one weight column per contrast."""
    names = sorted(r.name for r in contrasts.select("name").distinct().collect())
    own = contrasts.select(space.idx_or_fail("seq").alias("idx"), "name", "weight")
    blocks = []
    for k in range(0, len(names), BLOCK_COLUMNS):
        part = names[k:k + BLOCK_COLUMNS]
        columns = [F.sum(F.when(F.col("name") == n, F.col("weight")).otherwise(0.0)).alias(f"w{i}") for i, n in enumerate(part)]
        blocks.append((part, own.where(F.col("name").isin(part)).groupBy("idx").agg(*columns)))
    return blocks


def _contrast_table(spark, names: Sequence[str], estimate: Sequence[float], variance: Sequence[float]) -> DataFrame:
    rows = [(n, float(m), float(max(v, 0.0)) ** 0.5) for n, m, v in zip(names, estimate, variance)]
    return with_interval(spark.createDataFrame(rows, "name string, estimate double, std double"))


def precision_contrasts(states: DataFrame, space: Space, prior: Prior, weight: str, mean: str, contrasts: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """Contrasts of a posterior with precision C + diag(weight) and the given mean column."""
    found = []
    for names, weights in _weight_blocks(contrasts, space):
        cols = [f"w{i}" for i in range(len(names))]
        table = states.select("idx", weight, mean).join(weights, "idx", "left").na.fill(0.0, cols)
        solved = precision_solve(cut(table), space, prior, weight, cols, rtol)
        row = solved.agg(*[F.sum(F.col(c) * F.col(mean)).alias(f"m{c}") for c in cols], *[F.sum(F.col(c) * F.col(f"x_{c}")).alias(f"v{c}") for c in cols]).first()
        found += [(n, row[f"m{c}"], row[f"v{c}"]) for n, c in zip(names, cols)]
    return _contrast_table(states.sparkSession, *zip(*found))


def epistasis_regression_contrasts(obs: DataFrame, space: Space, p: int, a: float, contrasts: DataFrame, rtol: float = 1e-9) -> DataFrame:
    lam = a / K.n_faces(space, p) * K.delta_lambdas(space, p)
    states = cut(precision_solve(cut(_weighted(space, obs)), space, lam, "w", ["b"], rtol))
    return precision_contrasts(states, space, lam, "w", "x_b", contrasts, rtol)


# --- variance components ------------------------------------------------------------------------

class MomentFit:
    """Order variances from the second moments per distance: least squares on l + 1 numbers.

    The moment at distance d is a sum of the order variances times the projection entries, plus the noise at
    distance 0. Each equation counts with the root of its number of pairs.
    """

    def __init__(self, space: Space, cov: Sequence[float], n: Sequence[float], noise: float = 0.0):
        root = np.sqrt(np.asarray(n, dtype=float))
        clean = np.asarray(cov, dtype=float).copy()
        clean[0] -= noise
        self.design = root[:, None] * K.krawtchouk(space).T
        self.target = root * clean

    def error(self, variances: np.ndarray) -> float:
        """Squared misfit, summed over pairs."""
        misfit = self.design @ variances - self.target
        return float(misfit @ misfit)

    def fit(self, beta: float = 0.0) -> np.ndarray:
        """Variances at least 0; ``beta`` keeps the logarithms of those of the orders from 1 on close to a line."""
        plain = nonnegative_least_squares(self.design, self.target)
        if beta <= 0 or len(plain) < 4:
            return plain
        bend = np.sqrt(beta) * np.diff(np.eye(len(plain) - 1), n=2, axis=0) @ np.eye(len(plain))[1:]

        def residual(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            variances = np.exp(np.clip(logs, -200.0, 200.0))
            return (np.concatenate([self.design @ variances - self.target, bend @ logs]),
                    np.vstack([self.design * variances, bend]))

        floor = 1e-12 * max(float(plain.max()), 1e-280)
        return np.exp(damped_least_squares(residual, np.log(np.maximum(plain, 1e6 * floor)), np.log(floor)))


def _moments(df: DataFrame, length: int) -> tuple[list[float], list[float]]:
    rows = {r.d: r for r in small_rows(df, length + 1, "moment table")}
    return [rows[d].cov if d in rows else 0.0 for d in range(length + 1)], [rows[d].n if d in rows else 0 for d in range(length + 1)]


def fit_variance_components(obs: DataFrame, space: Space, beta: float = 0.0) -> np.ndarray:
    """Variance of each interaction order: second moments per distance from projections of the complete space."""
    states = observed_states(space, obs)
    cov, n = _moments(covariance_on_space(states, space), space.length)
    return MomentFit(space, cov, n, smallest_variance(states)).fit(beta)


def smallest_variance(states: DataFrame) -> float:
    return float(states.where("known").agg(F.min("y_var")).first()[0] or 0.0)


def fit_regularized(obs: DataFrame, space: Space, betas: Sequence[float] | None = None, folds: int = 5, seed: int = 0,
                    loss: str = "frobenius_norm") -> tuple[np.ndarray, float]:
    """Choose the smoothing by cross-validation and fit all data with it: (variances, beta)."""
    by_beta: dict[float, list[float]] = {}
    for beta, _, _, value in cross_validate_beta(obs, space, betas or [0.0, *regularization_grid()], folds, seed, loss):
        by_beta.setdefault(beta, []).append(value)
    best = min(sorted(by_beta), key=lambda b: float(np.mean(by_beta[b])))
    return fit_variance_components(obs, space, best), best


def regularization_grid(low: float = -2, high: float = 7, n: int = 20) -> list[float]:
    return [10.0 ** x for x in np.linspace(low, high, n)]


def cross_validate_beta(obs: DataFrame, space: Space, betas: Sequence[float], folds: int = 5, seed: int = 0, loss: str = "frobenius_norm") -> list[tuple]:
    """``(beta, log_beta, fold, loss)`` rows. One pass over the states gives the moments of all folds and roles."""
    if loss not in ("frobenius_norm", "logL", "r2"):
        raise ValueError(f"loss {loss} not allowed")
    folded = cut(assign_folds(merge_replicates(obs), folds, seed))
    if "y_var" not in folded.columns:
        folded = folded.withColumn("y_var", F.lit(0.0))
    rows = folded.select(space.idx_or_fail("seq").alias("idx"), "y", "y_var", "fold")
    inside = lambda k, v: F.sum(F.when(F.col("fold") == k, v).otherwise(0.0))
    per_state = rows.groupBy("idx").agg(
        F.sum("y").alias("y"), F.sum(F.lit(1.0)).alias("o"),
        *[inside(k, F.col("y")).alias(f"y{k}") for k in range(folds)], *[inside(k, F.lit(1.0)).alias(f"o{k}") for k in range(folds)])
    states = obs.sparkSession.range(space.n).withColumnRenamed("id", "idx").join(per_state, "idx", "left").na.fill(0.0)
    moments = covariance_by_fold(states, space, folds)
    tested = [F.col("fold").eqNullSafe(F.lit(k)) for k in range(folds)]
    noise = rows.agg(*[F.min(F.when(t if role == "test" else ~t, F.col("y_var"))).alias(f"{role}{k}") for k, t in enumerate(tested) for role in ("train", "test")]).first()
    out, held_out = [], []
    for k in range(folds):
        fits = {role: MomentFit(space, *zip(*moments[k][role]), float(noise[f"{role}{k}"] or 0.0)) for role in ("train", "test")}
        variances = [fits["train"].fit(beta) for beta in betas]
        if loss == "frobenius_norm":
            out += [fits["test"].error(v) for v in variances]
        else:
            held_out += [(k, v) for v in variances]
    if held_out:
        out = _held_out(folded, space, held_out, loss)
    labels = [(float(b), log10(b) if b > 0 else float("-inf"), k) for k in range(folds) for b in betas]
    return [(*label, float(v)) for label, v in zip(labels, out)]


def _held_out(folded: DataFrame, space: Space, variances: Sequence[tuple[int, np.ndarray]], loss: str) -> list[float]:
    """Losses of held-out predictions for ``(fold, variances)`` pairs; the posteriors of a block of pairs are one solve."""
    rows = without_missing(folded).withColumn("idx", space.idx_or_fail("seq"))
    folds = sorted({k for k, _ in variances})
    trains = lambda k: ~F.col("fold").eqNullSafe(F.lit(k))
    per_state = rows.select("idx", "y", "y_var", *[trains(k).alias(f"m{k}") for k in folds])
    states = cut(folded.sparkSession.range(space.n).withColumnRenamed("id", "idx").join(per_state, "idx", "left").na.fill(0.0))
    out = []
    for at in range(0, len(variances), BLOCK_COLUMNS):
        part = variances[at:at + BLOCK_COLUMNS]
        rhs, lams = [f"b{i}" for i in range(len(part))], [lam for _, lam in part]
        system = states.select("*", *[F.col("y").alias(c) for c in rhs])
        solved = space_solve.solve(system, space, lams, rhs, "y_var", [f"m{k}" for k, _ in part], 1e-6)
        means = space_solve.apply(solved, space, lams, [f"x_{c}" for c in rhs])
        found = _scores(rows, means, [(k, f"f{i}") for i, (k, _) in enumerate(part)])
        out += [-found[i].loglikelihood * found[i].n if loss == "logL" else -(found[i].r2 or 0.0) for i in range(len(part))]
    return out


def _scores(folded: DataFrame, predicted: DataFrame, columns: Sequence[tuple[int, str]]) -> dict:
    """Metrics of the test rows of a fold under a column of ``predicted``, by position in ``columns`` (pairs of both)."""
    each = F.array(*[F.struct(F.lit(i).alias("label"), F.lit(k).alias("tested"), F.col(c).alias("ypred")) for i, (k, c) in enumerate(columns)])
    own = F.filter(each, lambda s: s["tested"] == F.col("fold"))
    both = folded.where("fold is not null").join(predicted, "idx").select("y", "y_var", F.inline(own))
    return {r.label: r for r in metrics(both, "label", True).collect()}


# --- Gaussian-process posterior --------------------------------------------------------------------

Prior = Sequence[float] | K.Kernel  # eigenvalues per order, or any kernel


def _kernel(space: Space, prior: Prior) -> K.Kernel:
    return prior if isinstance(prior, K.Kernel) else K.order_kernel(space, prior)


def _solve_observed(states: DataFrame, space: Space, prior: Prior, rhs: Sequence[str], rtol: float) -> DataFrame:
    """Solve (K_BB + D) x = b on the observed states: adds ``x_<b>``, zero where nothing was observed."""
    if not isinstance(prior, K.Kernel):
        return space_solve.solve(states, space, [prior] * len(rhs), rhs, "y_var", "known", rtol)

    def apply(df: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
        held = [f"`{c}`" for c in df.columns]
        df = prior.apply(df, cols, outs)
        return df.selectExpr(*held, *[f"IF(known, `{o}` + y_var * `{c}`, 0D) AS `{o}`" for c, o in zip(cols, outs)])
    return conjugate_gradient(states, apply, rhs, f"{num(prior.diagonal)} + y_var", rtol)


def posterior_mean(obs: DataFrame, space: Space, prior: Prior, requested: DataFrame | None = None, rtol: float = 1e-9) -> DataFrame:
    """``(idx, seq, y)`` for all states, or for the sequences requested."""
    kernel = _kernel(space, prior)
    states = cut(observed_states(space, obs))
    solved = _solve_observed(states, space, prior, ["y"], rtol)
    mean = kernel.apply(solved, ["x_y"], ["f"])
    out = named_states(space, mean.select("idx", F.col("f").alias("y")), "y")
    return out if requested is None else out.join(requested.select("seq").distinct(), "seq", "left_semi")


def posterior_means(obs: DataFrame, space: Space, many: Sequence[Sequence[float]], rtol: float = 1e-9) -> DataFrame:
    """``(idx, f0, f1, ...)``: posterior means under several lists of variances, in one block solve."""
    rhs = [f"y{i}" for i in range(len(many))]
    states = cut(observed_states(space, obs).select("idx", "known", "y_var", *[F.col("y").alias(c) for c in rhs]))
    solved = space_solve.solve(states, space, many, rhs, "y_var", "known", rtol)
    return space_solve.apply(solved, space, many, [f"x_{c}" for c in rhs])


def posterior_contrasts(obs: DataFrame, space: Space, prior: Prior, contrasts: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """``(name, estimate, std, ci_95_lower, ci_95_upper, p)`` per contrast.

    With g = K w the variance is w'g - g'(K_BB + D)^-1 g and the estimate g'(K_BB + D)^-1 y, so the data
    and a block of contrasts are columns of one solve.
    """
    kernel = _kernel(space, prior)
    base, found = observed_states(space, obs), []
    for names, weights in _weight_blocks(contrasts, space):
        cols = [f"w{i}" for i in range(len(names))]
        states = base.join(weights, "idx", "left").na.fill(0.0, cols)
        states = kernel.apply(cut(states), cols, [f"g{c}" for c in cols])
        states = states.withColumns({f"r{c}": F.when(F.col("known"), F.col(f"g{c}")).otherwise(0.0) for c in cols})
        # the data are solved with the first block and kept for the others
        rhs = [*([] if found else ["y"]), *[f"r{c}" for c in cols]]
        solved = _solve_observed(cut(states), space, prior, rhs, rtol)
        row = solved.agg(
            *[F.sum(F.col(f"r{c}") * F.col("x_y")).alias(f"m{c}") for c in cols],
            *[(F.sum(F.col(c) * F.col(f"g{c}")) - F.sum(F.col(f"r{c}") * F.col(f"x_r{c}"))).alias(f"v{c}") for c in cols],
        ).first()
        if not found:
            base = solved.select("idx", "y", "y_var", "known", "x_y")
        found += [(n, row[f"m{c}"], row[f"v{c}"]) for n, c in zip(names, cols)]
    return _contrast_table(obs.sparkSession, *zip(*found))


def posterior_variance(obs: DataFrame, space: Space, prior: Prior, requested: Sequence[str], rtol: float = 1e-9) -> DataFrame:
    """``(seq, y, y_var, std, ci_95_lower, ci_95_upper)`` for a list of sequences, solved in blocks."""
    unit = obs.sparkSession.createDataFrame([(s, s, 1.0) for s in dict.fromkeys(requested)], "name string, seq string, weight double")
    out = posterior_contrasts(obs, space, prior, unit, rtol)
    return out.select(
        F.col("name").alias("seq"), F.col("estimate").alias("y"), (F.col("std") * F.col("std")).alias("y_var"), "std", "ci_95_lower", "ci_95_upper"
    )


def cross_validate_scale(obs: DataFrame, space: Space, p: int, a_values: Sequence[float], folds: int = 5, seed: int = 0, rtol: float = 1e-5) -> list[tuple]:
    """``(a, fold, logL)``: held-out mean log-density of the epistasis regression. All folds and scales are columns of block solves."""
    folded = cut(assign_folds(merge_replicates(without_missing(obs)), folds, seed).withColumn("idx", space.idx_or_fail("seq")))
    inside = lambda k, v: F.when(F.col("fold").eqNullSafe(F.lit(k)), 0.0).otherwise(v)
    per_state = folded.select("idx", *[c for k in range(folds) for c in (inside(k, 1.0 / F.col("y_var")).alias(f"w{k}"), inside(k, F.col("y") / F.col("y_var")).alias(f"b{k}"))])
    states = cut(obs.sparkSession.range(space.n).withColumnRenamed("id", "idx").join(per_state, "idx", "left").na.fill(0.0))
    problems = [(k, float(a)) for k in range(folds) for a in a_values]
    rows = []
    for at in range(0, len(problems), BLOCK_COLUMNS):
        part = problems[at:at + BLOCK_COLUMNS]
        rhs = [f"b{k}_{i}" for i, (k, _) in enumerate(part)]
        system = states.select("*", *[F.col(f"b{k}").alias(c) for c, (k, _) in zip(rhs, part)])
        lams = [a / K.n_faces(space, p) * K.delta_lambdas(space, p) for _, a in part]
        solved = precision_solve(system, space, lams, [f"w{k}" for k, _ in part], rhs, rtol)
        found = _scores(folded, solved.select("idx", *[f"x_{c}" for c in rhs]), [(k, f"x_{c}") for c, (k, _) in zip(rhs, part)])
        rows += [(a, k, float(found[i].loglikelihood)) for i, (k, a) in enumerate(part)]
    return sorted(rows, key=lambda r: (r[1], r[0]))
