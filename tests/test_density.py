from math import lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators.spaces import Space
from terrane.plans import build as B, density as D, kernels as K
from tests.test_regression import dense_kernel, sequences


@pytest.fixture(scope="module")
def sample(spark):
    space = Space.regular(3, "ABC")
    rng = np.random.default_rng(5)
    q = np.exp(rng.normal(size=27))
    counts = rng.multinomial(300, q / q.sum())
    rows = [(s, float(c)) for s, c in zip(sequences(space), counts) if c]
    return space, counts.astype(float), spark.createDataFrame(rows, "seq string, y double")


def dense_map(c, counts, n, steps=200):
    phi = np.full(len(counts), np.log(len(counts)))
    for _ in range(steps):
        e = n * np.exp(-phi)
        over = np.minimum(phi, 0)
        g = c @ phi + counts - e + 2 * over
        step = np.linalg.solve(c + np.diag(e + 2 * (over < 0)), g)
        phi = phi - step / max(1.0, np.abs(step).max())
    return phi


def test_map_field(spark, sample):
    space, counts, obs = sample
    prior = D.Prior(2, 30.0)
    fitted = D.fit_field(D.cut(D.density_states(space, obs)), space, prior)
    got = np.array([r.phi_c for r in fitted.orderBy("idx").collect()])
    c = dense_kernel(space, prior.lambdas(space))
    np.testing.assert_allclose(got, dense_map(c, counts, counts.sum()), atol=1e-4)
    table = D.density_table(fitted, space, allele_freqs={"A": 0.2, "B": 0.3, "C": 0.5})
    q = table.agg(F.sum("Q_star"), F.sum("Q_adj"), F.sum("frequency")).first()
    assert list(q) == pytest.approx([1, 1, 1])
    contrasts = spark.createDataFrame([("d", "AAA", 1.0), ("d", "CCC", -1.0)], "name string, seq string, weight double")
    row = D.density_contrasts(fitted, space, prior, contrasts).first()
    v = np.zeros(27)
    v[0], v[26] = 1, -1
    h = counts.sum() * np.exp(-got)
    assert row.std ** 2 == pytest.approx(v @ np.linalg.solve(c + np.diag(h), v), rel=1e-4)
    assert row.estimate == pytest.approx(got[0] - got[26], rel=1e-6)


def test_maximum_entropy_keeps_the_site_marginals(spark, sample):
    space, counts, obs = sample
    states = D.cut(D.density_states(space, obs))
    fitted = D.fit_field(states, space, D.Prior(2, D.INF))
    q = np.array([r.Q_star for r in D.density_table(fitted, space).orderBy("idx").collect()]).reshape(3, 3, 3)
    f = counts.reshape(3, 3, 3) / counts.sum()
    for axes in ((0, 1), (0, 2), (1, 2)):
        np.testing.assert_allclose(q.sum(axes), f.sum(axes), atol=1e-6)
    free = D.fit_field(states, space, D.Prior(2, 0.0))
    assert D.field_distance(free, free) == pytest.approx(0.0, abs=1e-6)
    assert D.field_distance(fitted, free) > 0.05


def test_pairwise_maximum_entropy(spark, sample):
    """P = 3: pair marginals are kept; with a penalty on low orders the gradient on them is zero."""
    space, counts, obs = sample
    states = D.cut(D.density_states(space, obs))
    fitted = D.fit_field(states, space, D.Prior(3, D.INF), rtol=1e-9)
    q = np.array([r.Q_star for r in D.density_table(fitted, space).orderBy("idx").collect()]).reshape(3, 3, 3)
    f = counts.reshape(3, 3, 3) / counts.sum()
    for axis in range(3):
        np.testing.assert_allclose(q.sum(axis), f.sum(axis), atol=1e-6)
    low = (0.0, 4.0)
    phi = np.array([r.phi_c for r in D.fit_field(states, space, D.Prior(2, D.INF, low), rtol=1e-9).orderBy("idx").collect()])
    project = dense_kernel(space, [1, 1, 0, 0])
    g = project @ (counts - counts.sum() * np.exp(-phi)) + dense_kernel(space, [0, 4, 0, 0]) @ phi
    np.testing.assert_allclose(g, 0, atol=1e-4)
    np.testing.assert_allclose(project @ phi, phi, atol=1e-8)


def test_no_convergence_is_reported(spark, sample):
    space, counts, obs = sample
    with pytest.raises(RuntimeError, match="converge"):
        D.fit_fields(D.cut(D.density_states(space, obs)), space, [("c", float(counts.sum()), D.Prior(2, 30.0))], max_steps=1)


def test_baseline_is_an_offset(spark, sample):
    space, counts, obs = sample
    rng = np.random.default_rng(0)
    off = np.abs(rng.normal(size=27))
    base = spark.createDataFrame([(s, float(v)) for s, v in zip(sequences(space), off)], "seq string, phi double")
    states = D.cut(D.density_states(space, obs, base))
    fitted = D.fit_field(states, space, D.Prior(2, 30.0))
    got = np.array([r.phi_c for r in fitted.orderBy("idx").collect()])
    c = dense_kernel(space, D.Prior(2, 30.0).lambdas(space))
    e = counts.sum() * np.exp(-(got + off))
    np.testing.assert_allclose(c @ got + counts - e, 0, atol=1e-3)


def test_sequences_outside_the_space_fail(spark, sample):
    space, _, _ = sample
    with pytest.raises(Exception, match="outside"):
        D.density_states(space, spark.createDataFrame([("ABZ", 1.0)], "seq string, y double")).collect()


def test_scale_cross_validation(spark, sample):
    """Every held-out value equals that of a fit of its own to the training counts."""
    space, counts, _ = sample
    rows = [(k, s, 1.0) for k, s in enumerate(x for x, c in zip(sequences(space), counts) for _ in range(int(c)))]
    obs = spark.createDataFrame(rows, "row_id bigint, seq string, y double")
    out = D.cross_validate_density(obs, space, 2, [0.0, 20.0, 100.0, D.INF], folds=2, rtol=1e-8)
    assert len(out) == 8 and D.best_scale(out) in (20.0, 100.0, D.INF)
    got = {(a, k): v for a, k, v in out}
    folded = D.assign_folds(obs, 2, 0, "row_id")
    for k in range(2):
        train = folded.where(f"fold is null or fold <> {k}").groupBy("seq").agg(F.sum("y").alias("y"))
        tests = {r.seq: r.n for r in folded.where(f"fold = {k}").groupBy("seq").agg(F.sum("y").alias("n")).collect()}
        for a in (20.0, D.INF) if k == 0 else ():
            q = {r.seq: r.Q_star for r in D.density_table(D.fit_field(D.cut(D.density_states(space, train)), space, D.Prior(2, a)), space).collect()}
            want = sum(n * log(q[s]) - lgamma(n + 1) for s, n in tests.items()) + lgamma(sum(tests.values()) + 1)
            assert got[a, k] == pytest.approx(want, abs=1e-4)
        unseen = set(tests) - {r.seq for r in train.collect()}
        assert (got[0.0, k] == -D.INF) == bool(unseen)


def test_build_saves_all_layers(spark, tmp_path):
    space = Space.regular(3, "AB")
    rng = np.random.default_rng(2)
    rows = [(s, float(rng.normal()), 0.01) for s in sequences(space)]
    data = spark.createDataFrame(rows, "seq string, y double, y_var double")
    B.build(spark, str(tmp_path), "toy", data, k=2)
    again = B.DataSet(spark, str(tmp_path), "toy")
    assert again.available == ["data", "landscape", "nodes", "edges", "relaxation_times"]
    assert again.layer("nodes").count() == 8 and again.layer("edges").count() == 12
    with pytest.raises(ValueError):
        again.layer("raw")
    with pytest.raises(ValueError):
        B.DataSet(spark, str(tmp_path), "absent")


def test_density_build_and_scale_grid(spark, tmp_path):
    space = Space.regular(2, "AB")
    rows = [(s,) for s, n in zip(sequences(space), (40, 10, 20, 30)) for _ in range(n)]
    data = spark.createDataFrame(rows, "X string")
    found, landscape, ns = B.infer_landscape(data, space, a=10.0)
    assert ns == 1.0 and landscape.agg(F.sum(F.exp("y"))).first()[0] == pytest.approx(1.0)
    counts = data.groupBy(F.col("X").alias("seq")).agg(F.count("*").alias("y"))
    grid = D.scale_grid(D.cut(D.density_states(space, counts)), space, 2, n=3)
    assert grid[0] == 0.0 and grid[-1] == D.INF and grid[1] < grid[2] < grid[3]


def large_sample(spark, total):
    space = Space.regular(3, "ABC")
    rng = np.random.default_rng(6)
    effects = sum(np.add.outer(np.zeros((3,) * k), rng.normal(size=(3,) * (3 - k))) for k in range(3))
    q = np.exp(effects.reshape(-1) + rng.normal(size=27) / 4)
    rows = [(s, float(round(total * x))) for s, x in zip(sequences(space), q / q.sum())]
    return space, D.cut(D.density_states(space, spark.createDataFrame(rows, "seq string, y double")))


def test_scale_grid_reaches_the_limit_of_large_samples(spark):
    space, states = large_sample(spark, 1e8)
    grid = D.scale_grid(states, space, 2, n=3, rtol=1e-6)
    limit = D.fit_field(states, space, D.Prior(2, D.INF))
    away = lambda a: D.field_distance(D.fit_field(states, space, D.Prior(2, a)), limit)
    assert away(1e4 * K.n_faces(space, 2)) > 0.1  # the end of the first decades
    assert away(grid[-2]) <= 0.1


def test_scale_grid_reports_an_end_it_does_not_reach(spark, monkeypatch):
    monkeypatch.setattr(D, "WIDER", 0)
    space, states = large_sample(spark, 1e8)
    with pytest.raises(ValueError, match="no scale within"):
        D.scale_grid(states, space, 2, n=3)
