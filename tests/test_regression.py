from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators.spaces import Space
from terrane.plans import kernels as K, regression as R


def sequences(space):
    out = [""]
    for site in space.alleles:
        out = [s + a for s in out for a in site]
    return out


def dense_kernel(space, lambdas):
    seqs = sequences(space)
    d = np.array([[sum(a != b for a, b in zip(x, y)) for y in seqs] for x in seqs])
    return K.kernel_by_distance(space, lambdas)[d]


def frame(spark, rows, schema="seq string, y double, y_var double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def noisy(spark):
    space = Space.regular(3, "ABC")
    rng = np.random.default_rng(3)
    lam = np.array([20.0, 8.0, 2.0, 0.5])
    truth = np.linalg.cholesky(dense_kernel(space, lam) + 1e-9 * np.eye(27)) @ rng.normal(size=27)
    seqs = sequences(space)
    kept = [i for i in range(27) if i % 5 != 2]
    rows = [(seqs[i], float(truth[i] + 0.1 * rng.normal()), 0.01 + 0.001 * i) for i in kept]
    return space, lam, kept, rows, frame(spark, rows)


def test_interpolation_of_three_corners(spark):
    obs = frame(spark, [("AA", 0.0), ("AB", 1.0), ("BA", 1.0)], "seq string, y double")
    got = {r.seq: r.y for r in R.interpolate(obs, Space.regular(2, "AB")).collect()}
    assert got == pytest.approx({"AA": 0, "AB": 1, "BA": 1, "BB": 2})


def test_interpolation_matches_dense_solution(spark, noisy):
    space, _, kept, rows, obs = noisy
    c = dense_kernel(space, K.delta_lambdas(space, 2))
    free = [i for i in range(27) if i not in kept]
    y = np.array([r[1] for r in rows])
    expected = -np.linalg.solve(c[np.ix_(free, free)], c[np.ix_(free, kept)] @ y)
    got = [r.y for r in R.interpolate(obs, space).orderBy("idx").collect()]
    np.testing.assert_allclose(np.array(got)[free], expected, atol=1e-6)
    np.testing.assert_allclose(np.array(got)[kept], y)


def test_epistasis_regression(spark, noisy):
    space, _, kept, rows, obs = noisy
    s = K.n_faces(space, 2)
    c = 50.0 / s * dense_kernel(space, K.delta_lambdas(space, 2))
    w, b = np.zeros(27), np.zeros(27)
    w[kept] = [1 / r[2] for r in rows]
    b[kept] = [r[1] / r[2] for r in rows]
    got = [r.y for r in R.epistasis_regression(obs, space, 2, 50.0).orderBy("idx").collect()]
    np.testing.assert_allclose(got, np.linalg.solve(c + np.diag(w), b), rtol=1e-6)
    contrasts = frame(spark, [("d", "AAA", 1.0), ("d", "CCC", -1.0)], "name string, seq string, weight double")
    row = R.epistasis_regression_contrasts(obs, space, 2, 50.0, contrasts).first()
    v = np.zeros(27)
    v[0], v[26] = 1, -1
    assert row.std ** 2 == pytest.approx(v @ np.linalg.solve(c + np.diag(w), v), rel=1e-6)


def test_corner_regression_keeps_exact_data(spark):
    obs = frame(spark, [("AA", 0.0, 1e-4), ("AB", 1.0, 1e-4), ("BA", 1.0, 1e-4)])
    got = {r.seq: r.y for r in R.epistasis_regression(obs, Space.regular(2, "AB"), 2, 1.0).collect()}
    assert got["BB"] == pytest.approx(2.0, abs=1e-2)


def test_posterior_mean_variance_and_contrasts(spark, noisy):
    space, lam, kept, rows, obs = noisy
    k = dense_kernel(space, lam)
    kbb = k[np.ix_(kept, kept)] + np.diag([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    mean = k[:, kept] @ np.linalg.solve(kbb, y)
    got = [r.y for r in R.posterior_mean(obs, space, lam).orderBy("idx").collect()]
    np.testing.assert_allclose(got, mean, rtol=1e-6, atol=1e-8)
    cov = k - k[:, kept] @ np.linalg.solve(kbb, k[kept])
    var = {r.seq: r for r in R.posterior_variance(obs, space, lam, ["AAC", "CBA"]).collect()}
    seqs = sequences(space)
    for s in ("AAC", "CBA"):
        i = seqs.index(s)
        assert var[s].y == pytest.approx(mean[i]) and var[s].y_var == pytest.approx(cov[i, i], rel=1e-5)
    contrasts = frame(spark, [("m", "AAC", 0.5), ("m", "CBA", 0.5), ("d", "AAC", 1.0), ("d", "AAA", -1.0)], "name string, seq string, weight double")
    rows = {r.name: r for r in R.posterior_contrasts(obs, space, lam, contrasts).collect()}
    v = np.zeros(27)
    v[seqs.index("AAC")], v[0] = 1, -1
    assert rows["d"].estimate == pytest.approx(v @ mean) and rows["d"].std == pytest.approx(np.sqrt(v @ cov @ v), rel=1e-5)
    assert rows["d"].ci_95_lower == pytest.approx(rows["d"].estimate - 2 * rows["d"].std)
    assert 0.5 <= rows["d"].p <= 1.0


def test_variance_component_fit_recovers_orders(spark):
    space = Space.regular(4, "ABC")
    lam = np.array([0.0, 10.0, 3.0, 0.5, 0.1])
    rng = np.random.default_rng(0)
    y = np.linalg.cholesky(dense_kernel(space, lam) + 1e-10 * np.eye(81)) @ rng.normal(size=81)
    obs = frame(spark, [(s, float(v), 0.0) for s, v in zip(sequences(space), y)])
    fitted = R.fit_variance_components(obs, space)
    u = np.array([y @ dense_kernel(space, np.eye(5)[k]) @ y for k in range(5)]) / K.multiplicities(space)
    np.testing.assert_allclose(fitted, u, rtol=1e-6, atol=1e-8)
    smooth = R.fit_variance_components(obs, space, beta=1e4)
    assert (smooth > 0).all()


def test_beta_cross_validation(spark, noisy):
    space, _, _, _, obs = noisy
    rows = R.cross_validate_beta(obs, space, [0.0, 1.0], folds=3)
    assert len(rows) == 6 and all(np.isfinite(r[3]) for r in rows)
    rows = R.cross_validate_beta(obs, space, [1.0], folds=2, loss="logL")
    assert len(rows) == 2



def test_replicates_leave_the_posterior_on_the_states(spark, noisy):
    space, lam, kept, rows, obs = noisy
    s, y, v = rows[0]
    split = frame(spark, [(s, y + 0.3, 2 * v), (s, y - 0.3, 2 * v), *rows[1:]])
    for f in (lambda o: R.posterior_mean(o, space, lam), lambda o: R.epistasis_regression(o, space, 2, 50.0)):
        a, b = ([(r.seq, r.y) for r in f(o).orderBy("idx").collect()] for o in (obs, split))
        assert [x[0] for x in a] == [x[0] for x in b] == sequences(space)
        np.testing.assert_allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)
    np.testing.assert_allclose(R.fit_variance_components(obs, space), R.fit_variance_components(split, space), rtol=1e-6, atol=1e-8)


def test_other_kernels(spark, noisy):
    space, lam, kept, rows, obs = noisy
    rho = [0.3, 0.5, 0.7]
    seqs = sequences(space)
    k = 2.0 * np.array([[np.prod([1 + 2 * r if a == b else 1 - r for a, b, r in zip(x, z, rho)]) for z in seqs] for x in seqs])
    y, d = np.array([r[1] for r in rows]), np.diag([r[2] for r in rows])
    mean = k[:, kept] @ np.linalg.solve(k[np.ix_(kept, kept)] + d, y)
    got = [r.y for r in R.posterior_mean(obs, space, K.connectedness_kernel(space, rho, 2.0)).orderBy("idx").collect()]
    np.testing.assert_allclose(got, mean, rtol=1e-6, atol=1e-7)
    same = [r.y for r in R.posterior_mean(obs, space, K.order_kernel(space, lam)).orderBy("idx").collect()]
    np.testing.assert_allclose(same, [r.y for r in R.posterior_mean(obs, space, lam).orderBy("idx").collect()])
    # a precision given as a map: the inverse of that kernel has 1 / rho at every site
    inverse = K.connectedness_kernel(space, [1 / r for r in rho], 1 / (2.0 * space.n ** 2))
    assert np.allclose(np.linalg.inv(k), [[np.prod([1 + 2 / r if a == b else 1 - 1 / r for a, b, r in zip(x, z, rho)]) / (2.0 * space.n ** 2) for z in seqs] for x in seqs])
    again = [r.y for r in R.epistasis_regression(obs, space, 2, precision=inverse, rtol=1e-10).orderBy("idx").collect()]
    np.testing.assert_allclose(again, mean, rtol=1e-4, atol=1e-5)


def test_regularized_fit_uses_the_best_beta(spark, noisy):
    space, _, _, _, obs = noisy
    lam, beta = R.fit_regularized(obs, space, [0.0, 1.0], folds=2)
    assert beta in (0.0, 1.0)
    np.testing.assert_allclose(lam, R.fit_variance_components(obs, space, beta))


def test_fold_moments_equal_those_of_the_parts(spark, noisy):
    from terrane.operators.cube import covariance_by_distance, covariance_by_fold
    space, _, _, rows, _ = noisy
    parts = [(space.rank(s), y, i % 2) for i, (s, y, _) in enumerate(rows)]
    states = [(i, *[0.0] * 6) for i in range(27)]
    for i, y, k in parts:
        row = [i, y, 1.0, 0.0, 0.0, 0.0, 0.0]
        row[3 + 2 * k], row[4 + 2 * k] = y, 1.0
        states[i] = tuple(row)
    df = spark.createDataFrame(states, "idx bigint, y double, o double, y0 double, o0 double, y1 double, o1 double")
    found = covariance_by_fold(df, space, 2)
    for k in range(2):
        for role, inside in (("train", lambda f: f != k), ("test", lambda f: f == k)):
            own = frame(spark, [(s, y) for (s, y, _), (_, _, f) in zip(rows, parts) if inside(f)], "seq string, y double")
            want = {r.d: (r.cov, float(r.n)) for r in covariance_by_distance(own, 3).collect()}
            for d, (cov, n) in enumerate(found[k][role]):
                assert n == want.get(d, (0, 0))[1] and cov == pytest.approx(want[d][0] if n else 0.0, abs=1e-9)


def folds_of(obs, folds):
    from terrane.operators.splits import assign_folds
    return {r.seq: r.fold for r in assign_folds(obs, folds, 0).collect()}


def test_scale_cross_validation(spark, noisy):
    """All folds and scales of one solve against dense posteriors."""
    space, _, kept, rows, obs = noisy
    got = {(k, a): v for a, k, v in R.cross_validate_scale(obs, space, 2, [5.0, 50.0], folds=3, rtol=1e-9)}
    fold, seqs = folds_of(obs, 3), sequences(space)
    c = dense_kernel(space, K.delta_lambdas(space, 2)) / K.n_faces(space, 2)
    assert len(got) == 6
    for (k, a), value in got.items():
        w, b = np.zeros(27), np.zeros(27)
        for i, (s, y, v) in zip(kept, rows):
            if fold[s] != k:
                w[i], b[i] = 1 / v, y / v
        mean = np.linalg.solve(a * c + np.diag(w), b)
        want = np.mean([-0.5 * (np.log(2 * np.pi * v) + (y - mean[seqs.index(s)]) ** 2 / v) for s, y, v in rows if fold[s] == k])
        assert value == pytest.approx(want, rel=1e-4)


def test_held_out_likelihood_of_all_folds(spark, noisy):
    space, _, kept, rows, obs = noisy
    from terrane.operators.splits import assign_folds
    lam = [np.array([20.0, 8.0, 2.0, 0.5]), np.array([5.0, 1.0, 1.0, 1.0])]
    problems = [(k, v) for k in range(3) for v in lam]
    got = R._held_out(assign_folds(obs, 3, 0), space, problems, "logL")
    fold = folds_of(obs, 3)
    for (k, v), value in zip(problems, got):
        c = dense_kernel(space, v)
        train, test = ([(i, y, s2) for i, (s, y, s2) in zip(kept, rows) if (fold[s] == k) == t] for t in (False, True))
        i, j = [x[0] for x in train], [x[0] for x in test]
        mean = c[np.ix_(j, i)] @ np.linalg.solve(c[np.ix_(i, i)] + np.diag([x[2] for x in train]), [x[1] for x in train])
        want = sum(0.5 * (np.log(2 * np.pi * s2) + (y - m) ** 2 / s2) for (_, y, s2), m in zip(test, mean))
        assert value == pytest.approx(want, rel=1e-3)


def test_own_precision_operator(spark, noisy):
    space, _, kept, rows, obs = noisy

    def laplacian(df, cols, outs):
        return K.apply_kernels(df, space, {o: (c, K.laplacian_lambdas(space)) for c, o in zip(cols, outs)})

    c = dense_kernel(space, K.laplacian_lambdas(space))
    free = [i for i in range(27) if i not in kept]
    expected = -np.linalg.solve(c[np.ix_(free, free)], c[np.ix_(free, kept)] @ np.array([r[1] for r in rows]))
    got = np.array([r.y for r in R.interpolate(obs, space, precision=laplacian).orderBy("idx").collect()])
    np.testing.assert_allclose(got[free], expected, atol=1e-6)


def test_smoothing_step(spark, noisy):
    space, _, _, _, obs = noisy
    plain = np.array([r.y for r in R.interpolate(obs, space).orderBy("idx").collect()])
    smooth = np.array([r.y for r in R.interpolate(obs, space, smooth=True).orderBy("idx").collect()])
    c = dense_kernel(space, K.delta_lambdas(space, 2))
    np.testing.assert_allclose(smooth, plain - c @ plain / K.faces_per_state(space, 2), atol=1e-8)
