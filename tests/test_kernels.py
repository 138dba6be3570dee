from itertools import combinations, product

import numpy as np
import pytest

from terrane.operators.spaces import Space
from terrane.plans import kernels as K


def vector(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx bigint, v double")


def values(df, c="u"):
    return np.array([r[c] for r in df.orderBy("idx").collect()])


def dense_laplacian(space):
    states = list(product(*[range(r) for r in space.radices]))
    d = np.array([[sum(x != y for x, y in zip(s, t)) for t in states] for s in states])
    a = (d == 1).astype(float)
    return np.diag(a.sum(1)) - a, d


@pytest.fixture(scope="module")
def case(spark):
    space = Space.regular(4, "ABC")
    v = np.random.default_rng(0).normal(size=space.n)
    L, d = dense_laplacian(space)
    return space, v, vector(spark, v), L, d


def test_small_laplacian(spark):
    df = vector(spark, [1, 2, 1, 0])
    assert values(K.laplacian(df, Space.regular(2, "AB"))).tolist() == [-1, 3, 1, -3]


def test_laplacian_matches_dense_also_for_irregular_spaces(spark, case):
    space, v, df, L, _ = case
    np.testing.assert_allclose(values(K.laplacian(df, space)), L @ v)
    odd = Space(("AB", "ABC", "ABCD"))
    w = np.arange(24.0) ** 1.5
    np.testing.assert_allclose(values(K.laplacian(vector(spark, w), odd)), dense_laplacian(odd)[0] @ w)


def test_kernel_uses_two_shuffles(case):
    space, _, df, _, _ = case
    plan = K.apply_kernel(df, space, [1.0, 2.0, 3.0, 4.0, 5.0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_projections_sum_to_identity_and_are_laplacian_eigenvectors(case):
    space, v, df, L, _ = case
    rows = K.order_columns(df, space).orderBy("idx").toPandas()
    u = rows[[f"_k{k}" for k in range(5)]].to_numpy()
    np.testing.assert_allclose(u.sum(1), v)
    for k in range(5):
        np.testing.assert_allclose(L @ u[:, k], 3.0 * k * u[:, k], atol=1e-9)


def test_delta_p_is_the_polynomial_of_the_laplacian(case):
    space, v, df, L, _ = case
    expected = (L @ (L @ v) - 3 * (L @ v)) / 2
    np.testing.assert_allclose(values(K.delta_p(df, space, 2)), expected, atol=1e-9)


def test_distance_sum_and_site_set_sum(case):
    space, v, df, _, d = case
    np.testing.assert_allclose(values(K.distance_neighbour_sum(df, space, 2)), (d == 2) @ v, atol=1e-9)
    states = list(product(range(3), repeat=4))
    hit = np.array([[all((a != b) == (s in (0, 2)) for s, (a, b) in enumerate(zip(x, y))) for y in states] for x in states])
    np.testing.assert_allclose(values(K.site_set_neighbour_sum(df, space, (0, 2))), hit @ v, atol=1e-9)


def test_connectedness_is_a_kronecker_product(case):
    space, v, df, _, _ = case
    rho = [0.1, 0.4, 0.7, 0.9]
    full = np.ones((1, 1))
    for r in rho:
        w0 = np.full((3, 3), 1 / 3)
        full = np.kron(full, w0 + r * (np.eye(3) - w0))
    np.testing.assert_allclose(values(K.apply_connectedness(df, space, rho)), full @ v, atol=1e-12)
    back = K.apply_connectedness(K.apply_connectedness(df, space, rho).select("idx", "u"), space, rho, "u", "w", power=-1.0)
    np.testing.assert_allclose(values(back, "w"), v)


def test_site_set_projections_resolve_each_order(case):
    space, v, df, _, _ = case
    second = sum(values(K.project_site_set(df, space, j)) for j in combinations(range(4), 2))
    np.testing.assert_allclose(second, values(K.apply_kernel(df, space, [0, 0, 1, 0, 0])), atol=1e-9)


def test_basis_round_trip(spark, case):
    space, v, df, _, _ = case
    b = {r.feature: r.b for r in K.to_basis(df, space, 3).collect()}
    assert len(b) == 1 + 4 * 2 + 6 * 4
    back = K.from_basis(space, 3, b, df.select("idx"), "u")
    np.testing.assert_allclose(values(back), values(K.apply_kernel(df, space, [1, 1, 1, 0, 0])), atol=1e-9)


def test_extended_lambdas():
    assert K.extended_delta_lambdas(Space.regular(3, "AB"), 2, [1.0, 1.0]).tolist() == [1, 1, 4, 12]


def test_log_det_and_diagonal():
    space = Space.regular(3, "AB")
    assert K.kernel_log_det(space, [1, 2, 4, 8]) == pytest.approx(np.log(2) * (3 + 6 + 3))
    assert K.kernel_diagonal(space, [1, 1, 1, 1]) == pytest.approx(1.0)


def test_a_scope_removes_its_steps(spark):
    from pathlib import Path

    from terrane.session import Stored, scope
    local = lambda step: Path(step.path.removeprefix("file:"))
    with scope():
        outer = Stored(spark.range(3))
        with scope():
            inner = Stored(spark.range(4))
            assert inner.table.count() == 4
        assert local(outer).exists() and not local(inner).exists()
    assert not local(outer).exists()
