import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators.spaces import Space
from terrane.plans import space_hitting as H
from tests.test_block_walk import dense_generator, landscape


def dense_hitting(q, one, zero):
    n = len(q)
    a, b = q.copy(), np.zeros(n)
    for i in {*one, *zero}:
        a[i] = 0.0
        a[i, i] = 1.0
        b[i] = 1.0 if i in one else 0.0
    return np.linalg.solve(a, b)


def states(spark, idx):
    return spark.createDataFrame([(i,) for i in idx], "idx long")


@pytest.mark.parametrize("ns, one, zero, degree", [(0.5, [0], [59], 8), (4.0, [3, 7, 7], [11, 40], 5)])
def test_probabilities_equal_dense_ones(spark, ns, one, zero, degree):
    space = Space(("ABC", "ABCD", "ABCDE"))
    y, nodes = landscape(spark, space, 4)
    q, _, _ = dense_generator(space, y, ns)
    got, found = H.hitting_probability(nodes, space, ns, states(spark, one), states(spark, zero), degree=degree)
    want = dense_hitting(q, set(one), set(zero))
    np.testing.assert_allclose([r.q for r in got.orderBy("idx").collect()], want, atol=1e-7)
    # the job that writes the start, one for each ``degree`` steps, and the check of the end
    assert found.jobs <= 2 + -(-found.steps // degree) + 2


def test_steps_in_coefficients_are_conjugate_gradients():
    r = np.random.default_rng(3)
    m = r.normal(size=(30, 30))
    m = m @ m.T
    d = 1 / np.sqrt(np.diag(m))
    m = 0.9 * d[:, None] * m * d / np.linalg.eigvalsh(d[:, None] * m * d)[-1] * 2 + 0.01 * np.eye(30)
    b = r.normal(size=30)
    x, res, p = np.zeros(30), b.copy(), b.copy()
    for _ in range(6):
        q = m @ p
        a = res @ res / (p @ q)
        x, new = x + a * p, res - a * q
        p, res = new + new @ new / (res @ res) * p, new
    t = np.eye(30) - m
    basis = [np.stack([b, b], 1)]
    basis.append(t @ basis[0])
    for _ in range(5):
        basis.append(2 * t @ basis[-1] - basis[-2])
    v = np.hstack(basis)
    got, direction, rest, taken, square = H._steps(v.T @ v, 6, 0.0)
    assert taken == 6 and square == pytest.approx(res @ res, rel=1e-5)
    np.testing.assert_allclose(v @ got, x, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(v @ direction, p, rtol=1e-5, atol=1e-7)


def test_nothing_to_reach(spark):
    space = Space.regular(3, "AB")
    _, nodes = landscape(spark, space, 4)
    got, found = H.hitting_probability(nodes, space, 1.0, states(spark, [0]).where("idx < 0"), states(spark, [3]))
    assert {r.q for r in got.collect()} == {0.0} and found.steps == 0
    got, _ = H.hitting_probability(nodes, space, 1.0, states(spark, range(8)), states(spark, [3]))
    assert [r.q for r in got.collect()] == [1.0] * 8
