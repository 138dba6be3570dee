"""Moments of long incomplete tables against all pairs, formed in plain Python."""

from collections import defaultdict

import numpy as np
import pytest

from terrane.operators import cube as C
from terrane.operators.pair_moments import pair_sums


def plain(rows, by_sites):
    sums = defaultdict(lambda: [0.0, 0])
    for s, y in rows:
        for t, z in rows:
            same = "".join("1" if a == b else "0" for a, b in zip(s, t))
            k = same if by_sites else same.count("0")
            sums[k][0] += y * z
            sums[k][1] += 1
    return {k: (v / n, n) for k, (v, n) in sums.items()}


def sample(n, length, alphabet="ACGT"):
    rng = np.random.default_rng(n)
    words = sorted({"".join(rng.choice(list(alphabet), length)) for _ in range(n)})
    return [(w, float(v)) for w, v in zip(words, rng.normal(size=len(words)))]


def test_distances_of_long_words(spark):
    rows = sample(60, 20)
    out = {r.d: (r.cov, int(r.n)) for r in C.covariance_by_distance(spark.createDataFrame(rows, "seq string, y double"), 20).collect()}
    want = plain(rows, False)
    assert set(out) == set(range(21))
    for d, got in out.items():
        assert got == pytest.approx(want.get(d, (0.0, 0)), abs=1e-9)


def test_sets_of_agreeing_sites(spark):
    rows = sample(50, 16, "AB")
    out = {r.sites: (r.cov, int(r.n)) for r in C.covariance_by_sites(spark.createDataFrame(rows, "seq string, y double"), 16).collect()}
    want = plain(rows, True)
    assert set(out) == set(want)
    for k, got in out.items():
        assert got == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_equal_to_the_cube_however_it_is_cut(spark, block_rows):
    """Six sites, which the cube can do too, with a key that has a clashing name."""
    rows = [(k, s, y + k) for k in (0, 1) for s, y in sample(25, 6, "AB")[k:]]
    df = spark.createDataFrame(rows, "lo int, seq string, y double")
    want = {(r.lo, r.d): (r.cov, int(r.n)) for r in C.covariance_by_distance(df, 6, ["lo"]).collect() if r.n}
    got = {(r.lo, r["class"]): (r.ss / float(r.nn), int(r.nn)) for r in pair_sums(df, 6, False, ["lo"], block_rows=block_rows).collect() if r.nn}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_replicates_nulls_and_nothing(spark):
    schema = "seq string, y double"
    twice = spark.createDataFrame([("A" * 15, 1.0), ("A" * 15, 3.0)], schema)
    row = C.covariance_by_distance(twice, 15).where("n > 0").first()
    assert (row.d, row.cov, int(row.n)) == (0, 4.0, 1)
    nothing = spark.createDataFrame([], schema)
    assert C.covariance_by_distance(nothing, 15).count() == 0 and C.covariance_by_sites(nothing, 15).count() == 0
    odd = pair_sums(spark.createDataFrame([(None, 2.0), ("AB", 1.0)], schema), 3, True).collect()
    assert {r["class"]: (r.ss, int(r.nn)) for r in odd} == {7: (5.0, 2), 1: (4.0, 2)}
    with pytest.raises(ValueError):
        pair_sums(twice, 63, True)
