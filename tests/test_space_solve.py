import numpy as np
import pytest

from terrane.operators.spaces import Space
from terrane.plans import kernels as K, space_solve as S
from tests.test_regression import dense_kernel


def test_orders_split_and_join():
    radices, r = (3, 2, 3), np.random.default_rng(1)
    v = r.normal(size=(36, 2))      # two groups of 18 cells
    parts = S.split_orders([v], radices)
    assert len(parts) == 4
    np.testing.assert_allclose(sum(parts), v)
    # a part has no other orders, and parts of different orders are orthogonal
    for j, part in enumerate(parts):
        again = S.split_orders([part], radices)
        np.testing.assert_allclose(again[j], part, atol=1e-12)
        np.testing.assert_allclose(S.join_orders([part if i == j else np.zeros_like(v) for i in range(4)], radices), part, atol=1e-12)
    np.testing.assert_allclose(S.join_orders([v] * 4, radices), v)


def problem(spark, space, columns, seed):
    r = np.random.default_rng(seed)
    lam = [r.uniform(0.1, 4.0, space.length + 1) for _ in range(columns)]
    known = r.random((columns, space.n)) < 0.7
    d, b = r.uniform(0.01, 0.5, (columns, space.n)), r.normal(size=(columns, space.n))
    rows = [(i, *[float(x) for x in d[:, i]], *[float(x) for x in b[:, i]], *[bool(x) for x in known[:, i]]) for i in range(space.n)]
    fields = ["idx long", *[f"d{k} double" for k in range(columns)], *[f"b{k} double" for k in range(columns)], *[f"m{k} boolean" for k in range(columns)]]
    return lam, known, d, b, spark.createDataFrame(rows, ", ".join(fields))


@pytest.mark.parametrize("length, letters, degree", [(5, "AB", 8), (3, "ABC", 3), (1, "ABCD", 2)])
def test_systems_of_their_own_equal_dense_ones(spark, length, letters, degree):
    space = Space.regular(length, letters)
    lam, known, d, b, states = problem(spark, space, 3, 5)
    names = ["b0", "b1", "b2"]
    masks = ["m0", "m1", None]
    known[2] = True
    got = S.solve(states, space, lam, names, ["d0", "d1", "d2"], masks, rtol=1e-10, degree=degree).orderBy("idx").toPandas()
    for k in range(3):
        m = known[k].astype(float)
        a = m[:, None] * dense_kernel(space, lam[k]) * m + np.diag(np.where(known[k], d[k], 1.0))
        want = np.linalg.solve(a, m * b[k])
        np.testing.assert_allclose(got[f"x_b{k}"], want, atol=1e-7 * np.abs(want).max())
    assert {"idx", "d0", "m0", "b0"} <= set(got.columns)


def test_steps_in_coefficients_are_conjugate_gradients():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(30, 30)))[0]
    m = q @ np.diag(r.uniform(0.05, 5.0, 30)) @ q.T
    b, top = r.normal(size=30), 6.0
    x, res, p = np.zeros(30), b.copy(), b.copy()
    for _ in range(6):
        a = res @ res / (p @ m @ p)
        x, new = x + a * p, res - a * (m @ p)
        p, res = new + new @ new / (res @ res) * p, new
    t = 2 / top * m - np.eye(30)
    basis = [np.stack([b, b], 1)]
    basis.append(t @ basis[0])
    for _ in range(5):
        basis.append(2 * t @ basis[-1] - basis[-2])
    v = np.hstack(basis)
    got, taken, square = S.take_steps(v.T @ v, 6, top, 0.0)
    assert taken == 6 and square == pytest.approx(res @ res, rel=1e-4)
    for k, want in enumerate((x, p, res)):
        np.testing.assert_allclose(v @ got[:, k], want, rtol=1e-4, atol=1e-6)


def test_zero_right_hand_sides_and_exact_rows(spark):
    space = Space.regular(4, "AB")
    states = spark.range(16).selectExpr("id AS idx", "0D AS none", "CAST(id AS DOUBLE) AS b", "id % 3 = 0 AS known")
    lam = K.delta_lambdas(space, 2) + 1.0
    got = S.solve(states, space, [lam, lam], ["none", "b"], "0D", [None, "known"]).orderBy("idx").collect()
    assert {r.x_none for r in got} == {0.0}
    inside = [i for i in range(16) if i % 3 == 0]
    c = dense_kernel(space, lam)
    want = np.zeros(16)
    want[inside] = np.linalg.solve(c[np.ix_(inside, inside)], inside)
    np.testing.assert_allclose([r.x_b for r in got], want, atol=1e-7)
    nothing = S.solve(states, space, [lam], ["none"], "1D").collect()
    assert len(nothing) == 16 and {r.x_none for r in nothing} == {0.0}


def test_missing_states_are_reported(spark):
    space = Space.regular(4, "AB")
    states = spark.range(15).selectExpr("id AS idx", "1D AS b")
    with pytest.raises(Exception, match="every state"):
        S.solve(states, space, [K.delta_lambdas(space, 2)], ["b"], "1D").collect()
