import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from terrane.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<float>, label int, codes int, ints string, _salt int"


def table(spark, rows):
    """Vectors, with columns whose names the operator uses."""
    return spark.createDataFrame([(i, v, l, 7, "x", 1) for i, v, l in rows], SCHEMA).repartition(3)


def brute_force(rows, parts, entries, rounds):
    """Plain Python: full scans, then codes, errors and the final codebooks."""
    rows = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[list(cut(v, p)) for _, v, _ in rows[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in rows:
                held.setdefault(assign(v, p)[1], []).append(cut(v, p))
            for k, members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, l in rows:
        found = [assign(v, p) for p in range(parts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def rows_of(seed, n, size, labels=4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        v = [round(r.gauss(0, 1) * 8) / 64 for _ in range(size)]
        rows.append((r.randrange(10 * n), v, r.choice([None, *range(labels)])))
    return rows


@pytest.mark.parametrize("seed, parts, entries, rounds", [(1, 16, 64, 2), (2, 4, 5, 4), (3, 2, 40, 3)])
def test_against_brute_force(spark, seed, parts, entries, rounds):
    rows = rows_of(seed, 300, 32)
    rows += [rows[0], rows[0], rows[5], (rows[7][0], rows[9][1], 2), (None, rows[3][1], 1), (-1, None, 1), (-2, [None] + [0.1] * 31, 1), (-3, [float("nan")] * 32, 0), (-4, [float("inf")] + [0.0] * 31, 0)]
    codes = V.compress(table(spark, rows), parts, entries, rounds)
    got = [tuple(r) for r in V.with_label_error(codes.table, 3).collect()]
    want, books = brute_force(rows, parts, entries, rounds)
    sums = {}
    for _, l, _, e in want:
        sums[l] = sums.get(l, 0) + e
    assert sorted(map(repr, got)) == sorted(repr((i, l, c, e, sums[l])) for i, l, c, e in want)
    assert [b.tolist() for b in codes.codebooks] == books


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_active_entries_give_what_a_full_scan_gives(seed):
    """Small whole numbers, so ties are frequent."""
    r = np.random.default_rng(seed)
    x = r.integers(-3, 4, (60, 2))
    old = r.integers(-3, 4, (12, 2))
    new, moved = old.copy(), r.random(12) < r.random()
    new[moved] += r.integers(-1, 2, (moved.sum(), 2))
    moved = (new != old).any(axis=1)
    code, distance = V.nearest(x, old)
    got_code, got_distance, compared = V.again(x, code, distance, new, moved)
    want_code, want_distance = V.nearest(x, new)
    assert (got_code == want_code).all() and (got_distance == want_distance).all()
    assert compared == sum(12 if moved[c] else moved.sum() for c in code)


def test_other_lengths_and_odd_parts(spark):
    rows = [(1, [0.5] * 5, 1), (2, [0.25] * 5, 1), (3, [1.0] * 7, 2), (4, [], 2)]
    got = {r.vec_id: r for r in V.with_label_error(V.compress(table(spark, rows)).table).collect()}
    assert got[3].code is None and got[4].code is None and got[3].label_error is None
    assert got[1].error == 0 and got[2].error == 0 and len(got[1].code) == 32


def test_empty_and_unusable_tables(spark):
    for rows in ([(1, None, 1)], [(1, [None], 1)], [(1, [], None)]):
        codes = V.compress(table(spark, rows))
        assert V.with_label_error(codes.table).count() == (1 if rows[0][1] == [] else 0)
    assert V.compress(table(spark, rows).where("vec_id < 0")).table.count() == 0


def test_components_beyond_a_long(spark):
    with pytest.raises(ValueError, match="too large"):
        V.compress(table(spark, [(1, [1e9] * 16, 1)]))
