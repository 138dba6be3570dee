import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators.spaces import Space
from terrane.plans import block_walk as B, embedding as E, space_modes as M, walk as W


def landscape(spark, space, seed=1, missing=()):
    r = np.random.default_rng(seed)
    y = r.normal(size=space.n)
    rows = [(i, float(v)) for i, v in enumerate(y) if i not in missing]
    return y, spark.createDataFrame(rows, "idx long, y double")


def dense_generator(space, y, ns, weights=None, exchange=None):
    """(Q, symmetric form, pi) by loops over all pairs of states."""
    states = list(product(*[range(r) for r in space.radices]))
    w = np.ones(space.n) if weights is None else np.asarray(weights) * space.n
    q = np.zeros((space.n, space.n))
    for i, a in enumerate(states):
        for j, b in enumerate(states):
            sites = [s for s in range(space.length) if a[s] != b[s]]
            if len(sites) == 1:
                s = ns * (y[j] - y[i])
                q[i, j] = (1.0 if abs(s) < 1e-12 else s / (1 - math.exp(-s))) * w[j]
                if exchange:
                    q[i, j] *= exchange[sites[0]][a[sites[0]]][b[sites[0]]]
    q -= np.diag(q.sum(1))
    p = w * np.exp(ns * (y - y.max()))
    p /= p.sum()
    root = np.sqrt(p)
    return q, root[:, None] * q / root, p


def test_products_equal_dense_ones(spark):
    space = Space(("ABC", "AB", "ABCD"))
    y, nodes = landscape(spark, space)
    r = np.random.default_rng(2)
    p0 = r.random(space.n)
    p0 /= p0.sum()
    exchange = [(lambda m: ((m + m.T) / 2).tolist())(r.random((n, n))) for n in space.radices]
    weighted = nodes.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p0)], "idx long, p0 double"), "idx")
    for table, weights, ex in ((nodes, None, None), (weighted, p0, None), (weighted, p0, exchange)):
        _, sym, p = dense_generator(space, y, 0.7, weights, ex)
        walk = B.BlockWalk(space, 0.7, ex)
        rows = walk.rows(table, p0="p0" if weights is not None else None)
        got = {x.idx: x for x in rows.table.collect()}
        np.testing.assert_allclose([got[i].leave for i in range(space.n)], -np.diag(sym), rtol=1e-12)
        np.testing.assert_allclose([got[i].root for i in range(space.n)], np.sqrt(p), rtol=1e-12)
        x = r.random((space.n, 2))
        df = rows.table.join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>"), "idx")
        mix = r.random((3, 4))
        steps = [B.Step(0.1, 0.5, 0.0), B.Step(0.2, -0.3, 0.7), B.Step(-0.1, 0.2, 0.4)]
        one = {a.idx: a for a in walk.polynomial(df, 2, steps, mix).collect()}
        v, z = np.hstack([x, np.sqrt(p)[:, None]]) @ mix, np.zeros((space.n, 4))
        for s in steps:
            v, z = s.alpha * sym @ v + s.beta * v + s.gamma * z, v
        np.testing.assert_allclose([one[i].x for i in range(space.n)], v, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose([one[i].u for i in range(space.n)], sym @ v, rtol=1e-9, atol=1e-12)


def test_left_out_states_take_no_part(spark):
    space = Space.regular(3, "ABC")
    y, nodes = landscape(spark, space)
    _, sym, _ = dense_generator(space, y, 1.0)
    walk = B.BlockWalk(space, 1.0)
    df = walk.rows(nodes).table.withColumn("x", F.array(F.col("idx") * 1.0)).where("idx not in (0, 13, 20)")
    got = {a.idx: a.u[0] for a in walk.polynomial(df, 1, []).collect()}
    kept = [i for i in range(27) if i not in (0, 13, 20)]
    np.testing.assert_allclose([got[i] for i in kept], sym[np.ix_(kept, kept)] @ np.array(kept, float), rtol=1e-10)


def test_large_steps_stay_finite():
    s = np.array([-2000.0, -1e-14, 0.0, 1e-9, 2000.0])
    assert np.isfinite(B.symmetric_rates(s)).all() and B.symmetric_rates(s)[3] == pytest.approx(1.0)
    np.testing.assert_allclose(B.step_rates(s), [0.0, 1.0, 1.0, 1.0, 2000.0], atol=1e-6)


def test_chebyshev_filter_is_small_on_the_interval():
    at = np.linspace(-10, -1, 50)
    for degree in (1, 4, 11):
        x, z = np.ones_like(at), np.zeros_like(at)
        one, zero = 1.0, 0.0
        for s in M.chebyshev_steps(-10, -1, degree):
            x, z = s.alpha * at * x + s.beta * x + s.gamma * z, x
            one, zero = s.beta * one + s.gamma * zero, one
        assert one == pytest.approx(1.0)
        assert abs(x).max() <= 1 / np.cosh(degree * np.arccosh(11 / 9)) + 1e-9


@pytest.mark.parametrize("ns", [0.0, 3.0])
def test_modes_equal_dense_eigenvectors(spark, ns):
    space = Space.regular(3, "ACGT")
    y, nodes = landscape(spark, space, 5)
    _, sym, p = dense_generator(space, y, ns)
    values, vectors = np.linalg.eigh(sym)
    placed, decay, found = M.diffusion_axes_on_space(nodes, space, ns, 4)
    got = [r.decay_rates for r in decay.orderBy("k").collect()]
    np.testing.assert_allclose(got, -values[::-1][1:5], rtol=1e-8)
    rows = sorted(placed.collect(), key=lambda r: r.idx)
    np.testing.assert_allclose([r.p for r in rows], p, rtol=1e-10)
    if ns:
        for c in range(4):
            want = vectors[:, -2 - c] / np.sqrt(p) / np.sqrt(-values[-2 - c])
            want *= -1 if want.mean() < 0 else 1
            np.testing.assert_allclose([r[f"axis_{c + 1}"] for r in rows], want, rtol=1e-3, atol=1e-4)


def test_modes_equal_those_of_the_edge_table(spark):
    space = Space(("ABC", "AB", "ABCDE"))
    _, nodes = landscape(spark, space, 3)
    p = W.stationary_frequencies(nodes, 1.5)
    _, want = E.diffusion_axes(p, W.transition_rates(p, space.edges(spark), 1.5, space.n), 3)
    _, got, _ = M.diffusion_axes_on_space(nodes, space, 1.5, 3)
    np.testing.assert_allclose([r.decay_rates for r in got.orderBy("k").collect()], [r.decay_rates for r in want.orderBy("k").collect()], rtol=1e-8)


def test_close_rates_of_one_site_take_few_products(spark):
    space = Space.regular(5, "ACGT")
    y, nodes = landscape(spark, space, 8)
    _, sym, p = dense_generator(space, y, 0.2)
    values, vectors = np.linalg.eigh(sym)
    found = M.slowest_modes(nodes, space, 0.2, 3, rtol=1e-6)
    np.testing.assert_allclose(found.rates, -values[::-1][1:4], rtol=1e-8)
    assert found.degrees < 80    # a block of 8 columns ends among the 15 modes of one site and took 122
    rows = found.table.table.selectExpr("idx", *[f"{m} AS m{c}" for c, m in enumerate(found.modes(3))]).orderBy("idx").collect()
    for c in range(3):
        assert abs(np.array([r[f"m{c}"] for r in rows]) @ vectors[:, -2 - c]) > 1 - 1e-6


def test_block_width():
    assert M.block_width(Space.regular(8, "ACGT"), 3) == 24 + 5 and M.block_width(Space.regular(8, "ACGT"), 30) == 60
    assert M.block_width(Space.regular(5, "ACDEFGHIKLMNPQRSTVWY"), 3) == 8    # 95 modes of one site are too wide
    assert M.block_width(Space.regular(1, "AB"), 3) == 1 and M.block_width(Space.regular(3, "ACGT"), 3, spare=2) == 5


def test_few_tasks_for_small_blocks(spark):
    set_before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        walk = B.BlockWalk(Space.regular(8, "ACGT"), 0.2)
        assert walk._dealt(spark.range(1).withColumnRenamed("id", "idx"), walk.blocks[0], 3 * 29).rdd.getNumPartitions() <= 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_before)


def test_small_spaces(spark):
    space = Space.regular(1, "AB")
    _, nodes = landscape(spark, space, 3)
    _, decay, _ = M.diffusion_axes_on_space(nodes, space, 0.0, 5)
    assert [round(r.decay_rates, 9) for r in decay.collect()] == [2.0]


def test_sweep_continues_from_the_modes_before(spark):
    space = Space.regular(3, "ACGT")
    _, nodes = landscape(spark, space, 5)
    nodes = nodes.cache()
    targets = E.sweep_targets(nodes, 3, 0.1, 0.8)
    out = M.ns_sweep_on_space(nodes, space, targets, 2).collect()
    assert len(out) == 3 * space.n
    by = {(r.step, r.idx): r for r in out}
    for s in range(1, 3):
        ns = by[s, 0].ns
        _, sym, p = dense_generator(space, np.array([r.y for r in nodes.orderBy("idx").collect()]), ns)
        values, vectors = np.linalg.eigh(sym)
        for c in (1, 2):
            got = np.array([by[s, i][f"axis_{c}"] for i in range(space.n)])
            want = vectors[:, -1 - c] / np.sqrt(p) / np.sqrt(-values[-1 - c])
            assert abs((p * got * want).sum()) / math.sqrt((p * want * want).sum() * (p * got * got).sum()) > 1 - 1e-5
            assert sum(p[i] * by[s, i][f"axis_{c}"] * by[s - 1, i][f"axis_{c}"] for i in range(space.n)) > 0
    # the second target from the first one's modes, next to a cold start
    first = M.slowest_modes(nodes, space, by[1, 0].ns, 2, rtol=1e-6)
    warm = M.slowest_modes(nodes, space, by[2, 0].ns, 2, rtol=1e-6, start=first)
    cold = M.slowest_modes(nodes, space, by[2, 0].ns, 2, rtol=1e-6)
    assert warm.degrees <= cold.degrees
    np.testing.assert_allclose(warm.rates, cold.rates, rtol=1e-6)
