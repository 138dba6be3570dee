"""Hand-computed tables for selections, alignments, spaces, statistics, splits, plots and files."""

import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.constants import DNA_AMBIGUITY, codon_table
from terrane.functions import seqcols as Q
from terrane.functions.special import lgamma, normal_cdf
from terrane.operators import cube as C, msa as M, plotdata as D, ranking as R, select as S, spaces as P, splits as X, stats as T
from terrane.operators.spaces import Space
from terrane.sources import tables as IO


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, c="seq"):
    return sorted(r[c] for r in df.collect())


# --- sequences ------------------------------------------------------------------------------

def test_sequence_columns(spark):
    df = frame(spark, [("ACGU", "ACG", "ATGTAAxx")], "a string, b string, c string")
    row = df.select(
        Q.hamming("a", "b").alias("h"), Q.reverse_complement("a").alias("rc"), Q.subsequence("a", [3, 0]).alias("sub"),
        Q.translate("c").alias("p"), Q.recode("b", [{"A": "x"}, {"C": "y"}, {}]).alias("code"), Q.mask_site("a", 1).alias("m"),
        Q.clamped_exp(F.lit(1000.0)).alias("e"), Q.translate(F.lit("auggcunnn")).alias("rna"),
    ).first()
    assert (row.h, row.rc, row.sub, row.p, row.code, row.m) == (1, "ACGU", "UA", "M*", "xyX", "A_GU")
    assert row.e == pytest.approx(math.exp(500)) and row.rna == "MAX"


def test_codon_changes():
    counts = P.codon_substitutions()
    totals = {a: sum(n for (x, _), n in counts.items() if x == a) for a in "WYAM"}
    assert totals == {"W": 9, "Y": 18, "A": 36, "M": 9}
    assert Counter(codon_table().values())["*"] == 3 and counts["A", "A"] == 12


def test_pattern_expansion(spark):
    df = frame(spark, [("RY",)], "pattern string")
    out = Q.expand_pattern(df, "pattern", [DNA_AMBIGUITY] * 2)
    assert [r.seq for r in out.orderBy("ord").collect()] == ["AC", "AT", "GC", "GT"]


def test_alphabets(spark):
    df = frame(spark, [(list("AC"),), (list("ACU"),), (list("ACDE"),), (list("AB"),)], "a array<string>")
    assert [r.k for r in df.select(Q.alphabet_type(F.col("a")).alias("k")).collect()] == ["dna", "rna", "protein", "custom"]
    assert Q.default_alphabet(3) == "012" and Q.default_alphabet(12) == "ABCDEFGHIJKL" and Q.default_alphabet(kind="rna") == "ACGU"


def test_special_functions(spark):
    row = frame(spark, [(5.0, 1.96)], "a double, b double").select(lgamma("a").alias("g"), normal_cdf("b").alias("n")).first()
    assert row.g == pytest.approx(math.log(24)) and row.n == pytest.approx(0.9750021)


def test_sql_functions(spark):
    from terrane.functions.special import register_sql
    register_sql(spark)
    assert column(spark.sql("SELECT * FROM expand_ambiguous('RY', 'dna')")) == ["AC", "AT", "GC", "GT"]
    assert spark.sql("SELECT lgamma(5.0D) AS g").first().g == pytest.approx(math.log(24))


# --- selections -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ab(spark):
    nodes = frame(spark, [(0, "AA", 3.0), (1, "AB", 1.0), (2, "BA", 1.0), (3, "BB", 3.0)], "idx bigint, seq string, function double")
    edges = frame(spark, [(i, j, k) for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 3), (3, 1), (3, 2)])], "i bigint, j bigint, id bigint")
    return nodes, edges


def test_selected_nodes_and_edges(spark, ab):
    nodes, edges = ab
    near = S.within_distance(nodes, S.listed(nodes, ["AA"]), 1, 2)
    assert column(near) == ["AA", "AB", "BA"]
    assert column(S.induced_edges(edges, near), "id") == [0, 1, 2, 4]
    hits = S.matching(nodes, "A[AB]")
    assert column(hits) == ["AA", "AB"] and column(S.induced_edges(edges, hits), "id") == [0, 2]
    assert column(S.within_distance(nodes, S.listed(nodes, ["AA"]), 2, 2)) == ["AA", "AB", "BA", "BB"]


def test_local_optima_tables(spark, ab):
    nodes, edges = ab
    assert column(P.local_optima(nodes, edges, "function")) == ["AA", "BB"]
    assert column(P.sequence_local_optima(nodes, Space.regular(2, "AB"), "function")) == ["AA", "BB"]


def test_ambiguity_selection_and_closest(spark):
    nodes = frame(spark, [(0, "A", -1.0, 1.0), (1, "C", 0.0, 0.0), (2, "G", 1.0, -1.0), (3, "T", 2.0, 0.0)], "idx bigint, seq string, `1` double, `2` double")
    assert column(S.matching_ambiguous(nodes, "Y", "dna")) == ["C", "T"]
    assert S.embedding_axes(nodes) == ["1", "2"]
    assert column(S.closest(nodes, "A", 2)) == ["A", "C"]
    flipped = nodes.withColumn("1", -F.col("1"))
    best = S.sign_alignment(flipped, nodes, ["1", "2"]).first()
    assert best.asDict() == {"distance": 0.0, "1": -1, "2": 1}
    assert [r["1"] for r in S.align_signs(flipped, nodes, ["1", "2"]).orderBy("idx").collect()] == [-1, 0, 1, 2]


def test_value_filters(spark, ab):
    nodes, _ = ab
    assert column(S.value_filter(nodes, top=2)) == ["AA", "BB"]
    assert column(S.value_filter(nodes, top=3, strict=True)) == ["AA", "BB"]
    assert column(S.value_filter(nodes, minimum=1.0, maximum=3.5)) == ["AA", "BB"]
    assert S.sort_nodes(nodes, color="absent") is nodes


def test_path_selection(spark, ab):
    nodes, _ = ab
    labels = frame(spark, [(0, "BB"), (1, "AB"), (2, "AA")], "pos bigint, seq string")
    picked, edges = S.path(nodes, labels)
    assert [r.seq for r in picked.orderBy("pos").collect()] == ["BB", "AB", "AA"]
    assert sorted((r.i, r.j) for r in edges.collect()) == [(0, 1), (1, 2)]


def test_state_sets(spark):
    ids = lambda *v: frame(spark, [(i,) for i in v], "idx bigint")
    assert column(S.complement(ids(0, 1, 2), ids(1)), "idx") == [0, 2]
    assert column(S.union_states(ids(0), ids(0, 4)), "idx") == [0, 4]
    with pytest.raises(ValueError):
        S.require_disjoint(ids(0, 1), ids(1))


# --- alignments -----------------------------------------------------------------------------

MSA6 = ["AGTGA", "AGTGA", "AGTCA", "TTACT", "TTACT", "TTACG"]


def brute_similar(seqs, max_dist):
    return {s: sum(sum(a != b for a, b in zip(s, t)) / len(s) < max_dist for t in seqs) for s in set(seqs)}


@pytest.mark.parametrize("max_dist", [0.15, 0.25, 0.45, 0.0, 1.5])
def test_similar_counts(spark, max_dist):
    rng = np.random.default_rng(0)
    seqs = ["".join(x) for x in rng.choice(list("AB"), size=(60, 7))]
    msa = frame(spark, [(s,) for s in seqs], "seq string")
    expected = brute_similar(seqs, max_dist)
    assert {r.seq: r.n_similar for r in M.similar_counts(msa, 7, max_dist).collect()} == expected
    m = M.max_mismatches(7, max_dist)
    if 0 <= m < 7:
        banded = M.banded_similar_counts(M.sequence_counts(msa), 7, m, block_rows=8)
        assert {r.seq: r.n_similar for r in banded.collect()} == expected


def test_long_alignment_uses_bands(spark):
    rng = np.random.default_rng(1)
    base = rng.choice(list("ACGT"), size=60)
    seqs = []
    for _ in range(50):
        s = base.copy()
        s[rng.choice(60, size=rng.integers(0, 20), replace=False)] = "T"
        seqs.append("".join(s))
    msa = frame(spark, [(s,) for s in seqs], "seq string")
    assert {r.seq: r.n_similar for r in M.similar_counts(msa, 60, 0.2).collect()} == brute_similar(seqs, 0.2)


def test_counts_weights_and_frequencies(spark):
    msa = frame(spark, list(enumerate(MSA6)), "row_id bigint, seq string")
    plain = {r.seq: r.y for r in M.msa_to_counts(msa, 5, [1, 2]).collect()}
    assert plain == {"GT": 3.0, "TA": 3.0}
    corrected = {r.seq: r.y for r in M.msa_to_counts(msa, 5, [1, 2], correct=True, max_dist=0.25).collect()}
    assert corrected == pytest.approx({"GT": 1.0, "TA": 1.0})
    with pytest.raises(ValueError):
        M.msa_to_counts(msa, 5, correct=True)
    weighted = frame(spark, [("AGCT", 1.0), ("ACGC", 1.0), ("AAAA", 2.0)], "seq string, w double")
    freqs = M.frequency_map(M.allele_frequencies(weighted, "w"))
    assert freqs == pytest.approx({"A": 10 / 16, "G": 2 / 16, "C": 3 / 16, "T": 1 / 16})
    assert column(M.repeated(frame(spark, [("A", 3), ("B", 1)], "seq string, n bigint"), chunk=2)) == ["A", "A", "A", "B"]


def test_reduced_code(spark):
    msa = frame(spark, [(0, "AC"), (1, "AG"), (2, "BG"), (3, "CT")], "row_id bigint, seq string")
    maps = M.code_maps(M.reduced_code(msa, [1, 2], 2), 2)
    assert maps == [{"A": "A", "B": "X", "C": "X"}, {"C": "C", "G": "G", "T": "X"}]
    renamed = M.code_maps(M.reduced_code(msa, 1, 2, keep_names=False), 2)
    assert renamed[1] == {"G": "A", "C": "X", "T": "X"}


# --- spaces ---------------------------------------------------------------------------------

def test_space_from_data(spark):
    data = frame(spark, list(enumerate(["BA", "BC", "AA", "AC"])), "row_id bigint, seq string")
    space = P.infer_space(data, order="row_id")
    assert space.alleles == ("BA", "AC")
    assert [r.seq for r in space.states(spark).orderBy("idx").collect()] == ["BA", "BC", "AA", "AC"]
    with pytest.raises(ValueError):
        P.infer_space(data.limit(3), order="row_id")
    odd = frame(spark, [("AB",), ("AC",)], "seq string")
    assert P.infer_space(odd, full=False, regular=True).alleles == ("0A", "BC")
    assert P.infer_space(odd, full=False, regular=True, shared_alleles=True).alleles == ("ABC", "ABC")


def test_states_and_edges_of_an_irregular_space(spark):
    space = Space(("AV", "AVT"))
    assert [r.seq for r in space.states(spark).orderBy("idx").collect()] == ["AA", "AV", "AT", "VA", "VV", "VT"]
    assert space.edges(spark).count() == 6 * 3
    codon = {(r.i, r.j) for r in P.codon_edges(space, spark).collect()}
    assert (1, 2) not in codon and (0, 2) in codon and (0, 1) in codon
    with pytest.raises(Exception, match="outside"):
        frame(spark, [("AX",)], "seq string").select(space.idx_or_fail("seq")).collect()


@pytest.mark.parametrize("d", [1, 2, 3])
def test_hamming_ball(spark, d):
    ball = P.hamming_ball(spark, "ATG", Space.regular(3, "ACGT"), d)
    assert ball.count() == sum(math.comb(3, k) * 3 ** k for k in range(d + 1)) == ball.select("idx").distinct().count()
    degree = {r.i: r["count"] for r in P.hamming_edges(ball, 3).groupBy("i").count().collect()}
    assert degree[Space.regular(3, "ACGT").rank("ATG")] == 9


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_edges_of_copies(spark, monkeypatch, block_rows):
    monkeypatch.setattr(P, "BLOCK_ROWS", block_rows)
    rows = [(k, ("AC", "AG", "TC", "TG", "GT")[k * k % 5]) for k in range(30)] + [(3, "AC"), (3, "AC"), (None, "AG"), (None, "AC"), (40, None)]
    nodes = frame(spark, rows, "idx bigint, seq string")
    want = sorted(((a, b) for a, s in rows for b, t in rows if s and t and sum(x != y for x, y in zip(s, t)) == 1), key=str)
    assert sorted(((r.i, r.j) for r in P.hamming_edges(nodes, 2, copies=True).collect()), key=str) == want
    assert sorted(((r.i, r.j) for r in P.hamming_edges(nodes, 2).collect()), key=str) == want


def test_pairs_of_copies_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_PAIRS", 1 << 14)
    nodes = spark.range(2048).selectExpr("id AS idx", "substr('ACGT', CAST(id % 4 AS INT) + 1, 1) AS seq")
    edges = P.hamming_edges(nodes.selectExpr("idx", "concat(seq, substr('ACGT', CAST(idx DIV 4 % 4 AS INT) + 1, 1)) AS seq"), 2, copies=True)
    held = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2048 * 6 * 128 and max(held) < sum(held) / 8


def test_neighbourhood_without_listed_pairs(spark):
    words = ("AC", "AG", "TC", "TG", "GT", "CA")
    rows = [(k, words[k * k % 11 % 6]) for k in range(30)] + [(3, "AC"), (3, "AC"), (7, "CC"), (None, "AG"), (None, "TT"), (40, None), (None, None)]
    nodes = frame(spark, rows, "idx bigint, seq string")
    pairs = {(a, b) for a, s in rows for b, t in rows if s and t and sum(x != y for x, y in zip(s, t)) == 1}
    for seeds in ([7, 7, 40, None], []):
        want, last = Counter((i, 0) for i in set(seeds)), set(seeds)
        for k in (1, 2, 3):
            seen = {i for i, _ in want} - {None}  # null equals nothing: it is met anew
            last = {b for a, b in pairs if a in last and a is not None} - seen
            want.update((i, k) for i in last)
        for edges in (P.hamming_edges(nodes, 2, listed=False), P.hamming_edges(nodes, 2, copies=True)):
            got = P.neighbourhood(edges, frame(spark, [(i,) for i in seeds], "idx bigint"), 3)
            assert Counter((r.idx, r.hops) for r in got.collect()) == want


def test_two_hops_over_copies_list_no_pairs(spark, tmp_path):
    from terrane.catalog.selections import two_hop_neighbours
    keys = [65536 * k + w for k in range(500) for w in (0, 1, 2, 6, 22, 40)]
    frame(spark, [(k, 9950.0 if k in (0, 65538) else 5.0) for k in keys], "c_custkey bigint, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    plan = two_hop_neighbours(spark, str(tmp_path))._jdf.queryExecution()
    assert plan.toRdd().count() == 500 * 5

    def counts(node):
        kids = [f() for name, f in (("AdaptiveSparkPlanExec", lambda: node.executedPlan()), ("QueryStageExec", lambda: node.plan())) if node.getClass().getSimpleName().endswith(name)]
        if node.metrics().contains("numOutputRows"):
            yield node.metrics().apply("numOutputRows").value()
        for kid in kids or [node.children().apply(i) for i in range(node.children().size())]:
            yield from counts(kid)

    found = list(counts(plan.executedPlan()))
    assert len(found) > 9 and max(found) <= 2 * len(keys)  # there are 2.5 M pairs
    hops = Counter((r.idx % 65536, r.hops) for r in two_hop_neighbours(spark, str(tmp_path)).collect())
    assert hops == {(0, 0): 1, (2, 0): 1, (0, 1): 499, (1, 1): 500, (2, 1): 499, (6, 1): 500, (22, 2): 500}


def test_grid_space(spark):
    nodes, edges = P.grid_space(spark, 3, 2)
    assert edges.count() == 24 and [r.label for r in nodes.orderBy("idx").limit(4).collect()] == ["0-0", "0-1", "0-2", "1-0"]
    y = {r.label: r.y for r in P.peak_surface(nodes, [[0, 0]], 2.0).collect()}
    assert y["2-1"] == pytest.approx(-1.5)


def test_validity_report(spark):
    nodes = frame(spark, [(0, 1.0), (1, None)], "idx bigint, y double")
    edges = frame(spark, [(0, 1, 1.0), (1, 0, 2.0), (0, 0, 1.0), (0, 7, -1.0), (7, 0, -1.0)], "i bigint, j bigint, w double")
    row = P.validity_report(nodes, edges).first()
    assert row.asDict() == {"loops": 1, "asymmetric": 2, "negative": 2, "orphans": 1, "missing_y": 1}


def test_missing_values_stop_the_job(spark):
    space = Space.regular(1, "AB")
    with pytest.raises(Exception, match="no value"):
        P.sequence_space(spark, frame(spark, [("A", 1.0)], "seq string, y double"), space)[1].collect()


# --- moments and metrics ------------------------------------------------------------------------

def test_covariance_by_sites(spark):
    rows = [(s, float(v)) for s, v in zip(["AA", "AB", "BA", "BB"], [1, -1, 1, -1])]
    out = {r.sites: (r.cov, r.n) for r in C.covariance_by_sites(frame(spark, rows, "seq string, y double"), 2).collect()}
    assert out == {"11": (1.0, 4), "01": (1.0, 4), "10": (-1.0, 4), "00": (-1.0, 4)}


def test_incomplete_moments_match_pairs(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(x) for x in product("ABC", repeat=4)]
    kept = [(s, float(rng.normal())) for s in seqs if rng.random() < 0.7]
    got = {r.d: (r.cov, r.n) for r in C.covariance_by_distance(frame(spark, kept, "seq string, y double"), 4).collect()}
    for d in range(5):
        pairs = [a * b for (s, a), (t, b) in product(kept, kept) if sum(x != z for x, z in zip(s, t)) == d]
        assert got[d][1] == len(pairs) and got[d][0] == pytest.approx(np.mean(pairs))


def test_epistasis_cost_of_additive_tables(spark):
    space = Space.regular(3, "AB")
    additive = frame(spark, [(i, float(bin(i).count("1"))) for i in range(8)], "idx bigint, y double")
    assert C.epistasis_cost(additive, space, 2).first().cost == pytest.approx(0, abs=1e-12)
    pair = frame(spark, [(i, float((i >> 2 & 1) * (i >> 1 & 1))) for i in range(8)], "idx bigint, y double")
    assert C.epistasis_cost(pair, space, 2).first().cost == pytest.approx(2.0)
    assert C.epistasis_cost(pair, space, 3).first().cost == pytest.approx(0, abs=1e-12)


def test_metrics(spark):
    truth = frame(spark, [("A", 1.0, 0.1), ("B", 2.0, 0.1), ("C", 3.0, 0.1)], "seq string, y double, y_var double")
    pred = frame(spark, [("x", "A", 1.1), ("x", "B", 2.1), ("x", "C", 2.9), ("one", "A", 1.0), ("gap", "A", None)], "label string, seq string, ypred double")
    rows = {r.label: r for r in T.evaluate(pred, truth).collect()}
    assert set(rows) == {"x", "one"} and rows["one"].r2 is None and rows["one"].mse == 0
    assert rows["x"].mse == pytest.approx(0.01) and rows["x"].r2 == pytest.approx(np.corrcoef([1.1, 2.1, 2.9], [1, 2, 3])[0, 1] ** 2)
    assert rows["one"].loglikelihood == pytest.approx(-0.5 * math.log(2 * math.pi * 0.1))


@pytest.mark.parametrize("values", [[5.0] * 50, list(range(37)), [1.0, 1.0, 2.0, 1e9, -3.5]])
def test_percentiles(spark, values):
    df = frame(spark, [(float(v),) for v in values], "y double")
    qs = [0, 10, 33.3, 50, 80, 100]
    np.testing.assert_allclose(R.percentiles(df, "y", qs), np.percentile(values, qs))
    small = [R.order_statistics(df, "y", [k], bins=4, final=2)[0] for k in range(len(values))]
    assert small == sorted(map(float, values))


# --- splits ----------------------------------------------------------------------------------

def test_folds(spark):
    obs = spark.range(103).select(F.col("id").cast("string").alias("seq"), F.lit(1.0).alias("y"))
    folded = X.assign_folds(obs, 10, 1)
    sizes = Counter(r.fold for r in folded.collect())
    assert sizes == {**{k: 10 for k in range(10)}, None: 3}
    roles = X.fold_roles(X.assign_folds(obs, 10, 1, max_pred=4), 10)
    assert roles.where("role = 'test'").count() == 40 and roles.where("role = 'train'").count() == 930
    with pytest.raises(ValueError):
        X.assign_folds(obs.limit(3), 10)


def test_training_design(spark):
    design = X.training_design(n_ps=3, n_reps=2)
    assert [(i, round(p, 12), r) for i, p, r in design] == [(1, 0.05, 0), (2, 0.05, 1), (3, 0.5, 0), (4, 0.5, 1), (5, 0.95, 0), (6, 0.95, 1)]
    obs = spark.range(400).select(F.col("id").cast("string").alias("seq"), F.lit(1.0).alias("y"))
    capped = X.training_splits(obs, design, max_pred=7)
    assert capped.where("role = 'test'").groupBy("id").count().agg(F.max("count")).first()[0] == 7
    fixed = X.training_splits(obs, design, max_pred=50, fixed_test=True)
    tests = fixed.where("role = 'test'").groupBy("rep", "seq").count()
    assert tests.count() == 100 and tests.select("count").distinct().collect()[0][0] == 3
    share = fixed.where("role = 'train' and id = 3").count() / 400
    assert 0.4 < share < 0.6


# --- plots and files ------------------------------------------------------------------------------

def test_segments_and_rasters(spark):
    nodes = frame(spark, [(0, 0.0, 1.0, 1.0), (1, 1.0, 2.0, 5.0), (2, 2.0, 3.0, 2.0)], "idx bigint, x double, y double, c double")
    edges = frame(spark, [(0, 1), (1, 0), (1, 2)], "i bigint, j bigint")
    seg = {(r.i, r.j, r.end): (r.x, r.y) for r in D.segments(nodes, edges, ["x", "y"]).collect()}
    assert seg == {(1, 0, 0): (1.0, 2.0), (1, 0, 1): (0.0, 1.0), (2, 1, 0): (2.0, 3.0), (2, 1, 1): (1.0, 2.0)}
    pixels = {(r.px, r.py): r.c for r in D.node_raster(nodes, "x", "y", 4, "c").collect()}
    assert pixels == {(0, 0): 1.0, (2, 2): 5.0, (3, 3): 2.0}
    lines = {(r.px, r.py): r.c for r in D.edge_raster(nodes, edges.where("i = 0 or j = 2"), "x", "y", 4).collect()}
    assert lines == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 2.0, (3, 3): 1.0}


def test_tables_on_disk(spark, tmp_path):
    df = frame(spark, [("A", 1.0), ("B", 2.0)], "seq string, y double")
    for kind in ("csv", "parquet", "pq"):
        IO.write_table(df, f"{tmp_path}/t.{kind}")
        assert sorted(map(tuple, IO.read_table(spark, f"{tmp_path}/t.{kind}").collect())) == [("A", 1.0), ("B", 2.0)]
    for f in (lambda: IO.read_table(spark, "x.json"), lambda: IO.write_table(df, "x.json")):
        with pytest.raises(ValueError):
            f()
    assert IO.read_edges(spark, None) is None
    pred = frame(spark, [("s1", "A", 1.5)], "label string, seq string, ypred double")
    IO.write_predictions(pred, f"{tmp_path}/pred")
    assert IO.read_predictions(spark, f"{tmp_path}/pred").first().label == "s1"


def test_ball_of_long_words(spark):
    centre = "ACGT" * 7 + "AC"
    ball = P.hamming_ball(spark, centre, Space.regular(30, "ACGT"), 1)
    rows = ball.collect()
    assert len(rows) == len({r.seq for r in rows}) == len({r.idx for r in rows}) == 91
    assert all(Space.regular(30, "ACGT").rank(r.seq) == r.idx for r in rows)
    longer = P.hamming_ball(spark, "A" * 40, Space.regular(40, "ACGT"), 2).collect()  # no 63-bit index
    assert len(longer) == len({r.idx for r in longer}) == 1 + 120 + 9 * 780
    seen = spark.createDataFrame([("A" * 40,), ("C" + "A" * 38 + "G",)], "seq string")
    assert {r.seq: r.distance for r in P.hamming_ball_of(seen, "A" * 40).collect()} == {
        "A" * 40: 0, "C" + "A" * 39: 1, "A" * 39 + "G": 1, "C" + "A" * 38 + "G": 2}
    assert P.hamming_ball_of(seen, "A" * 40, alphabet="ACGT").count() == 1 + 120 + 9 * 780


def test_state_index_of_long_words(spark):
    space = Space.regular(30, "ACGT")
    word = "TGCA" * 7 + "TG"
    row = spark.createDataFrame([(word,)], "seq string").select(space.idx_of("seq").alias("idx")).select("idx", space.seq_of("idx").alias("a"), space.seq_of(F.col("idx")).alias("b")).first()
    assert (row.idx, row.a, row.b) == (space.rank(word), word, word)


def test_replicates_are_merged_by_inverse_variance(spark):
    from terrane.operators.replicates import merge_replicates
    rows = [("AA", 1.0, 1.0), ("AA", 4.0, 0.5), ("AB", 2.0, 0.0), ("AB", 4.0, 0.0), ("AB", 9.0, 1.0), ("BB", 7.0, 3.0)]
    obs = spark.createDataFrame(rows, "seq string, y double, y_var double")
    got = {r.seq: (r.y, r.y_var) for r in merge_replicates(obs).collect()}
    assert got == {"AA": (pytest.approx(3.0), pytest.approx(1 / 3)), "AB": (3.0, 0.0), "BB": (7.0, 3.0)}
    assert {r.seq: r.y for r in merge_replicates(obs.drop("y_var")).collect()} == {"AA": 2.5, "AB": 5.0, "BB": 7.0}


def test_replicates_change_no_face_and_no_pair(spark):
    from terrane.operators import cube as C
    one = spark.createDataFrame([(a + b, float(i)) for i, (a, b) in enumerate((a, b) for a in "AB" for b in "AB")], "seq string, y double")
    twice = one.union(one.where("seq = 'AA'"))
    for f in (lambda o: C.covariance_by_distance(o, 2), lambda o: C.covariance_by_sites(o, 2), lambda o: C.local_epistasis(o, 2, 1)):
        assert sorted(f(one).collect()) == sorted(f(twice).collect())


def test_percentiles_with_infinite_values_end(spark):
    from terrane.operators import ranking as R
    rows = spark.range(20_000).select((F.col("id") * 0.5).alias("v"))
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    assert R.order_statistics(rows.union(ends), "v", [0, 1, 10_000, 20_000, 20_001, 20_002]) == [float("-inf"), 0.0, 4999.5, 9999.5, float("inf"), pytest.approx(float("nan"), nan_ok=True)]
    assert R.percentile(rows.union(ends.where("v = 'inf'")), "v", 100) == float("inf")
    assert R.percentile(ends.where("v = '-inf'"), "v", 50) == float("-inf")


def test_distance_join_on_segments(spark):
    rng = np.random.default_rng(4)
    seqs = sorted({"A" * 6 + "".join(rng.choice(list("ACGT"), 4)) for _ in range(120)})  # a part that all rows share
    nodes = spark.createDataFrame([(s,) for s in seqs], "seq string")
    focal = spark.createDataFrame([(seqs[3],), (seqs[50],)], "seq string")
    for d in (0, 1, 2, 10):
        near = [s for s in seqs if min(sum(a != b for a, b in zip(s, f)) for f in (seqs[3], seqs[50])) <= d]
        assert sorted(r.seq for r in S.within_distance(nodes, focal, d, 10).collect()) == near


def test_stored_direction_keeps_its_weight(spark):
    from terrane.sources.tables import symmetric
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (1, 2, 5.0)], "i bigint, j bigint, w double")
    assert sorted(tuple(r) for r in symmetric(edges).collect()) == [(0, 1, 2.0), (1, 0, 3.0), (1, 2, 5.0), (2, 1, 5.0)]


def test_cross_validation_with_own_functions(spark):
    from terrane.operators.splits import cross_validate
    obs = spark.createDataFrame([(f"s{i}", float(i)) for i in range(12)], "seq string, y double")
    sizes = []
    fit = lambda train, v: sizes.append(train.count()) or v
    out = cross_validate(obs, fit, lambda test, v: v * test.count(), [1.0, 2.0], folds=3, process=lambda df: df.where("y <> 100"))
    assert sorted((r.value, r.fold, r.loss) for r in out.collect()) == [(v, f, 4.0 * v) for v in (1.0, 2.0) for f in range(3)]
    assert set(sizes) == {8}
