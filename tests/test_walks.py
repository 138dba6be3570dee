import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators.spaces import Space, hamming_edges, max_min_edges
from terrane.plans import embedding as E, paths as P, walk as W


def nodes_of(spark, space, y):
    rows = [(i, float(v)) for i, v in enumerate(y)]
    return space.states(spark).join(spark.createDataFrame(rows, "idx bigint, y double"), "idx")


def states(spark, *idx):
    return spark.createDataFrame([(i,) for i in idx], "idx bigint")


def dense(df, n, c="rate"):
    m = np.zeros((n, n))
    for r in df.collect():
        m[r.i, r.j] += r[c]
    return m


@pytest.fixture(scope="module")
def net6(spark):
    links = [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 5)]
    rates = spark.createDataFrame([(i, j, 1.0) for a, b in links for i, j in ((a, b), (b, a))], "i bigint, j bigint, rate double")
    nodes = spark.range(6).select(F.col("id").alias("idx"), F.lit(1 / 6).alias("p"))
    return nodes, rates


def test_ns_calibration(spark):
    nodes = spark.createDataFrame([(i, y) for i, y in enumerate([1.0, 0.0, 0.5, 0.75])], "idx bigint, y double")
    mean = W.stationary_sweep(nodes, [1.0]).first().mean_function
    assert W.calibrate_ns(nodes, mean) == pytest.approx(1.0, abs=1e-4)
    assert W.calibrate_ns(nodes, 0.5625) == 0.0
    assert W.stationary_sweep(nodes, [W.calibrate_ns(nodes, perc=75)]).first().mean_function == pytest.approx(np.percentile([1.0, 0.0, 0.5, 0.75], 75))
    with pytest.raises(ValueError):
        W.calibrate_ns(nodes, 1.0)


def test_transition_rates(spark):
    space = Space.regular(2, "AB")
    nodes = nodes_of(spark, space, [0, 1, 0, 1])
    rates = W.transition_rates(nodes, space.edges(spark), 1.0, 4)
    q = dense(W.with_diagonal(rates), 4)
    assert q[0, 1] == pytest.approx(1 / (1 - math.exp(-1)))
    assert q[1, 0] == pytest.approx(-1 / (1 - math.exp(1)))
    assert q[0, 2] == 1.0
    np.testing.assert_allclose(q.sum(1), 0, atol=1e-12)
    p = {r.idx: r.p for r in W.stationary_frequencies(nodes, 1.0).collect()}
    s = dense(rates, 4, "sym")
    root = np.sqrt([p[i] for i in range(4)])
    np.testing.assert_allclose(np.diag(root) @ (q - np.diag(np.diag(q))) @ np.diag(1 / root), s)


def test_jump_chain(spark):
    rates = spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 2.0)], "i bigint, j bigint, rate double")
    p = dense(W.jump_chain(rates, spark.range(4).withColumnRenamed("id", "idx")), 4, "p")
    np.testing.assert_allclose(p, [[0, 1, 0, 0], [0.5, 0, 0.5, 0], [0, 1, 0, 0], [0, 0, 0, 1]])


def test_committors_and_flows(spark, net6):
    nodes, rates = net6
    for reversible in (True, False):
        q = P.committors(nodes, rates, states(spark, 0), states(spark, 5), reversible=reversible)
        got = q.orderBy("idx").collect()
        np.testing.assert_allclose([r.q_forward for r in got], [0, 1 / 3, 1 / 3, 2 / 3, 2 / 3, 1], atol=1e-8)
        np.testing.assert_allclose([r.q_backward for r in got], [1, 2 / 3, 2 / 3, 1 / 3, 1 / 3, 0], atol=1e-8)
    flows = P.cut(P.effective_flows(q, rates))
    assert all(r.eff_flow == pytest.approx(1 / 18) for r in flows.where("eff_flow > 1e-9").collect())
    assert P.reactive_rate(flows, states(spark, 0)).first().rate == pytest.approx(2 / 18)


def test_committors_with_avoided_states(spark, net6):
    nodes, rates = net6
    q = P.committors(nodes, rates, states(spark, 0), states(spark, 5), states(spark, 4))
    got = P.reactive_probabilities(q).orderBy("idx").collect()
    np.testing.assert_allclose([r.q_forward for r in got], [0, 1 / 3, 0, 2 / 3, 0, 1], atol=1e-8)
    np.testing.assert_allclose([r.q_backward for r in got], [1, 2 / 3, 0.5, 1 / 3, 0, 0], atol=1e-8)
    np.testing.assert_allclose([r.conditional for r in got], [0, 0.5, 0, 0.5, 0, 0], atol=1e-8)
    assert P.reactive_rate(P.effective_flows(q, rates), states(spark, 0)).first().rate == pytest.approx(1 / 18)


def test_pathway_of_an_irreversible_walk(spark, net6):
    nodes, rates = net6
    rates = rates.withColumn("rate", F.when((F.col("i") == 0) & (F.col("j") == 2), 0.5).otherwise(F.col("rate")))
    q = P.committors(nodes, rates, states(spark, 0), states(spark, 5), reversible=False)
    flows = P.cut(P.effective_flows(q, rates).withColumnRenamed("eff_flow", "w"))
    row = P.pathway(flows, states(spark, 0), states(spark, 5)).first()
    assert row.nodes == [0, 1, 3, 5] and row.eff_flow == pytest.approx(0.05555556)
    assert P.bottleneck(flows, states(spark, 0), states(spark, 5)).first().min_flow == pytest.approx(0.05555556)


@pytest.mark.parametrize("y,flow", [([2, 0, 2, 2, 2, 2, 0, 2], 0.040054396), ([2, 0, 0, 0, 2, 2, 0, 2], None)])
def test_pathways_add_up_to_the_rate(spark, y, flow):
    space = Space.regular(3, "AB")
    nodes = W.stationary_frequencies(nodes_of(spark, space, y), 0.628)
    rates = W.transition_rates(nodes, space.edges(spark), 0.628, 8)
    q = P.committors(nodes, rates, states(spark, 7), states(spark, 0))
    flows = P.cut(P.effective_flows(q, rates))
    steps = P.pathways(flows, states(spark, 7), states(spark, 0)).collect()
    rate = P.reactive_rate(flows, states(spark, 7)).first().rate
    assert len(steps) == 18
    assert sum(r.eff_flow for r in steps if r.step == 0) == pytest.approx(rate)
    if flow:
        assert steps[0].eff_flow == pytest.approx(flow)
        assert not {1, 6} & {r.i for r in steps if r.path == 0}


def test_hitting_through(spark):
    for extra, expected in (([], 0.5), ([(0, 4), (4, 3)], 1 / 3)):
        links = [(0, 1), (0, 2), (1, 3), (2, 3)] + extra
        rates = spark.createDataFrame([(i, j, 1.0) for a, b in links for i, j in ((a, b), (b, a))], "i bigint, j bigint, rate double")
        n = 4 + bool(extra)
        nodes = spark.range(n).select(F.col("id").alias("idx"), F.lit(1 / n).alias("p"))
        q = P.hitting_through(nodes, rates, states(spark, 3), states(spark, 2))
        assert q.where("idx = 0").first().q == pytest.approx(expected)


def test_reactive_jumps(spark):
    space = Space.regular(2, "AB")
    nodes = W.stationary_frequencies(nodes_of(spark, space, [2, 0, 2, 2]), 0.628)
    rates = W.transition_rates(nodes, space.edges(spark), 0.628, 4)
    q = P.committors(nodes, rates, states(spark, 0), states(spark, 3))
    p = dense(P.reactive_jumps(q, rates, states(spark, 0), states(spark, 3)), 4, "p")
    np.testing.assert_allclose(p.sum(1), 1)
    assert p[3, 3] == 1
    raw = dense(rates, 4)
    np.testing.assert_allclose(p[0], raw[0] / raw[0].sum())


def test_max_min_paths(spark):
    def run(space, y, start, end, bypasses):
        nodes = nodes_of(spark, space, y)
        edges = max_min_edges(nodes, space.edges(spark), start, end, space.length, bypasses)
        row = P.max_min_path(nodes, edges, space.rank(start), space.rank(end)).first()
        names = {r.idx: r.seq for r in nodes.collect()}
        return [names[i] for i in row.nodes]

    two, three = Space.regular(3, "AB"), Space.regular(2, "ABC")
    assert run(two, [3, 2, 1, 2, 1, 1, 1, 3], "AAA", "BBB", False) == ["AAA", "AAB", "ABB", "BBB"]
    assert run(two, [3, 2, 1, 2, 3, 1, 3, 3], "AAA", "BBB", False) == ["AAA", "BAA", "BBA", "BBB"]
    y = [3, 2, 2, 3, 1, 3, 2, 3, 3]
    assert run(three, y, "AA", "CC", False) == ["AA", "AC", "CC"]
    assert run(three, y, "AA", "CC", True) == ["AA", "BA", "BC", "CC"]


def test_reachability_and_path_counts(spark):
    space = Space.regular(4, "AB")
    nodes = nodes_of(spark, space, range(16))
    direct = max_min_edges(nodes, space.edges(spark), "AAAA", "BBBB", 4, False)
    assert P.count_paths(direct, 0, 15, 4).first().n_paths == 24
    assert P.has_path(direct, states(spark, 0), states(spark, 15))
    assert not P.has_path(direct, states(spark, 15), states(spark, 0))


def test_embedding_matches_dense_eigenvectors(spark):
    space = Space(("ABC", "AB", "ABCD"))
    y = np.random.default_rng(1).normal(size=space.n)
    nodes = nodes_of(spark, space, y)
    ns, placed, decay = E.embed_landscape(nodes, space.edges(spark), space.n, k=4, ns=0.7)
    rates = W.transition_rates(nodes, space.edges(spark), 0.7, space.n)
    q = dense(W.with_diagonal(rates), space.n)
    p = np.exp(0.7 * y) / np.exp(0.7 * y).sum()
    sym = np.diag(np.sqrt(p)) @ q @ np.diag(1 / np.sqrt(p))
    values, vectors = np.linalg.eigh((sym + sym.T) / 2)
    got = [r.decay_rates for r in decay.orderBy("k").collect()]
    np.testing.assert_allclose(got, -values[::-1][1:5], rtol=1e-8)
    rows = placed.orderBy("idx").collect()
    axis = np.array([r.axis_1 for r in rows])
    right = vectors[:, -2] / np.sqrt(p) / np.sqrt(got[0])
    np.testing.assert_allclose(axis, right * np.sign(right.mean()), atol=1e-5)
    assert axis.mean() >= 0


def test_dna_models(spark):
    freqs, exchange = W.dna_model("HKY85", 2, {"A": 0.1, "C": 0.2, "G": 0.3, "T": 0.4}, {"a": 1.0, "b": 2.0})
    space = Space.regular(2, "ACGT")
    e = W.neutral_edges(spark, space, exchange, freqs)
    q = {(r.i, r.j): r for r in e.collect()}
    assert q[0, 2].exchange == 2.0 and q[0, 1].exchange == 1.0 and q[1, 3].exchange == 2.0
    assert q[0, 2].rate == pytest.approx(2.0 * 0.1 * 0.3)
    with pytest.raises(ValueError):
        W.dna_model("JC", 1)


def test_space_walk_equals_the_edge_walk(spark):
    from terrane.plans import space_walk as X
    space = Space(("AB", "ABC", "AB"))
    rng = np.random.default_rng(1)
    rows = [(i, float(y), float(v)) for i, (y, v) in enumerate(zip(np.round(rng.normal(size=12), 1), rng.normal(size=12)))]
    nodes = spark.createDataFrame(rows, "idx bigint, y double, v double")
    q = np.zeros((12, 12))
    for r in W.with_diagonal(W.transition_rates(nodes, space.edges(spark), 1.5, 12)).collect():
        q[r.i, r.j] = r.rate
    got = [r.u for r in X.generator_applied(nodes, space, 1.5).orderBy("idx").collect()]
    np.testing.assert_allclose(got, q @ np.array([r[2] for r in rows]), atol=1e-9)
    state = lambda i: spark.createDataFrame([(i,)], "idx bigint")
    hit = [r.q for r in X.hitting_probability_on_space(nodes, space, 1.5, state(11), state(0)).orderBy("idx").collect()]
    a, b = q.copy(), np.zeros(12)
    a[0], a[11], b[11] = np.eye(12)[0], np.eye(12)[11], 1.0
    np.testing.assert_allclose(hit, np.linalg.solve(a, b), atol=1e-7)


def test_bottleneck_edge(spark):
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 3, 2.0), (0, 2, 1.0), (2, 3, 9.0)], "i bigint, j bigint, w double")
    state = lambda i: spark.createDataFrame([(i,)], "idx bigint")
    assert [tuple(r) for r in P.bottleneck_edge(edges, state(0), state(3)).collect()] == [(1, 3, 2.0)]
    assert P.bottleneck_edge(edges, state(3), state(0)).count() == 0


def test_path_numbers_of_any_size(spark):
    """All states of ten on one level lead to all of the next: 10^29 paths of 30 steps, and one more of a single step."""
    links = [(0, 1 + k) for k in range(10)] + [(1 + 10 * s + a, 11 + 10 * s + b) for s in range(28) for a in range(10) for b in range(10)]
    links += [(281 + a, 291) for a in range(10)] + [(0, 291)]
    edges = spark.createDataFrame(links, "i long, j long")
    assert P.path_number(edges, 0, 291, 40) == 10 ** 29 + 1
    assert P.path_number(edges, 0, 291, 5) == 1 and P.path_number(edges, 291, 0, 5) == 0
    assert P.count_paths(edges, 0, 291, 30).first().n_paths == str(10 ** 29 + 1)


def test_direct_paths_of_a_cube(spark):
    space = Space.regular(7, "AB")
    up = space.edges(spark).where("j > i")
    row = P.count_paths(up, 0, 127, 7).first()
    assert row.n_paths == math.factorial(7)


def test_residues():
    primes = P.moduli(200)
    assert all(q % d for q in primes for d in range(2, 50_000)) and len(set(primes)) == len(primes)
    for n in (0, 1, 2 ** 61, 3 ** 120):
        assert P.from_residues([n % q for q in primes], primes) == n


def test_a_breakdown_is_named(spark):
    """A quarter turn: the first product is orthogonal to the residual."""
    from terrane.plans.solvers import bicgstab, edge_apply
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, -1.0)], "i long, j long, w double")
    system = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 0.0)], "idx long, b double, d double")
    with pytest.raises(RuntimeError, match="broke down"):
        bicgstab(system, edge_apply(edges, "d"), "b")
