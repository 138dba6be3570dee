"""Fits of the decay per site against all pairs, formed in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators.spaces import Space
from terrane.plans import connectedness as C
from terrane.plans.regression import observed
from terrane.plans.smallfit import descend


def words(space):
    out = [""]
    for site in space.alleles:
        out = [s + a for s in out for a in site]
    return out


def pair_kernel(seqs, space, rho):
    k = np.ones((len(seqs), len(seqs)))
    for s, (a, r) in enumerate(zip(space.radices, rho)):
        col = np.array([x[s] for x in seqs])
        k *= np.where(col[:, None] == col[None, :], 1 + (a - 1) * r, 1 - r)
    return k


def pair_loss(y, kernel, c):
    return ((np.outer(y, y) - kernel - c) ** 2).mean() - (np.outer(y, y) ** 2).mean()


def frame(spark, seqs, y):
    return spark.createDataFrame([(s, float(v)) for s, v in zip(seqs, y)], "seq string, y double")


def moments(spark, space, obs):
    given = observed(space, obs).select("idx", "y", F.lit(1.0).alias("o"))
    return C.Moments(C.site_set_norms(given, space, {"y": "y", "o": "o"}), space)


SPACES = [Space.regular(4, "AB"), Space.regular(3, "ACGT"), Space(("AB", "XYZ", "0123", "C"))]


@pytest.mark.parametrize("space", SPACES)
def test_loss_and_slope_equal_all_pairs(spark, space):
    rng = np.random.default_rng(5)
    seqs = [s for i, s in enumerate(words(space)) if i % 4 != 1]
    y = rng.normal(size=len(seqs)) + 0.5
    m = moments(spark, space, frame(spark, seqs, y))
    rhos = rng.uniform(0.1, 0.9, size=(2, space.length))
    h = 1e-6
    shifted = np.concatenate([[r + h * e, r - h * e] for r in rhos for e in np.eye(space.length)])
    found, around = m.losses(rhos), [f[0] for f in m.losses(shifted)]
    for i, (rho, (loss, slope, c)) in enumerate(zip(rhos, found)):
        k = pair_kernel(seqs, space, rho)
        assert c == pytest.approx(max((np.outer(y, y) - k).mean(), -1), rel=1e-9)
        assert loss == pytest.approx(pair_loss(y, k, c), rel=1e-9)
        own = np.array(around[2 * i * space.length:2 * (i + 1) * space.length]).reshape(-1, 2)
        np.testing.assert_allclose(slope, (own[:, 0] - own[:, 1]) / (2 * h), rtol=1e-5, atol=1e-7)


def test_norms_of_site_sets(spark):
    space = Space(("AB", "XYZ", "CD"))
    v = np.random.default_rng(1).normal(size=space.n)
    states = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx bigint, v double")
    got = {r.mask: r.q for r in C.site_set_norms(states, space, {"v": "q"}).collect()}
    cube = v.reshape(space.radices)
    for mask in range(8):
        part = cube
        for s in range(3):
            mean = np.broadcast_to(part.mean(s, keepdims=True), cube.shape)
            part = part - mean if mask >> (2 - s) & 1 else mean
        assert got[mask] == pytest.approx((part ** 2).sum(), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("space, rho", [(Space.regular(3, "AB"), [0.3, 0.6, 0.8]), (Space.regular(8, "AB"), [0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 0.5, 0.2])])
def test_best_of_all_sets_of_sites(spark, space, rho):
    """No point near the fit, and not the rho the data come from, has a smaller loss over all pairs."""
    rng = np.random.default_rng(2)
    seqs = words(space)
    values, vectors = np.linalg.eigh(pair_kernel(seqs, space, rho))
    y = vectors @ (np.sqrt(np.maximum(values, 0)) * np.where(np.arange(len(seqs)) % 2, 1.0, -1.0))
    log_mu, fitted = C.fit_connectedness(frame(spark, seqs, y), space)
    at = lambda r: pair_loss(y, k := pair_kernel(seqs, space, r), max((np.outer(y, y) - k).mean(), -1))
    best = at(fitted)
    assert best == pytest.approx(pair_loss(y, pair_kernel(seqs, space, fitted), np.exp(log_mu) - 1), rel=1e-7)
    assert best <= at(np.array(rho)) + 1e-9 * abs(best)
    for e in rng.normal(size=(20, space.length)):
        assert best <= at(np.clip(fitted + 1e-3 * e, 0, 1)) + 1e-9 * abs(best)


def test_twenty_sites(spark):
    """A million states: values that are products over sites have second moments that are such products."""
    space = Space.regular(20, "AB")
    rho = np.linspace(0.1, 0.9, 20)
    # one value a site, so the norm of a site set is the product of its sites' rho, and y y' falls by site as the kernel does
    row = [f"(CASE WHEN {space.digit_sql(s)} = 0 THEN {1 + r ** 0.5!r}D ELSE {1 - r ** 0.5!r}D END)" for s, r in enumerate(rho.tolist())]
    obs = spark.range(space.n).selectExpr("id AS idx", " * ".join(row) + " AS y")
    log_mu, fitted = C.fit_connectedness(obs, space)
    np.testing.assert_allclose(fitted, rho, atol=1e-4)
    assert log_mu == pytest.approx(0.0, abs=1e-4)


def test_replicates_and_one_observation(spark):
    space = Space.regular(2, "AB")
    twice = frame(spark, ["AA", "AA", "AB", "BA", "BB"], [1.0, 3.0, 1.0, -1.0, 0.5])
    once = frame(spark, ["AA", "AB", "BA", "BB"], [2.0, 1.0, -1.0, 0.5])
    a, b = C.fit_connectedness(twice, space), C.fit_connectedness(once, space)
    assert a[0] == pytest.approx(b[0], abs=1e-6)
    np.testing.assert_allclose(a[1], b[1], atol=1e-5)
    log_mu, rho = C.fit_connectedness(frame(spark, ["AB"], [2.0]), space)
    assert np.isfinite(log_mu) and ((rho >= 0) & (rho <= 1)).all()


def test_descend_takes_the_best_start():
    def at(many):
        return [(float((x[0] ** 2 - 1) ** 2 + 0.1 * x[0] + (x[1] - 2) ** 2), np.array([4 * x[0] * (x[0] ** 2 - 1) + 0.1, 2 * (x[1] - 2)])) for x in many]
    best = descend(at, np.array([[2.0, 0.0], [-2.0, 0.0]]))
    assert best[0] == pytest.approx(-1.0123, abs=1e-3) and best[1] == pytest.approx(2.0, abs=1e-5)
