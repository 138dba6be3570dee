import zlib

import pytest
from pyspark.sql import functions as F

from terrane.llm import sharding as S
from tests.llm import cases


def checked(rows, got):
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for s in range(S.SHARDS):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    return [sum(r.size for r in got if r.shard == s) for s in range(S.SHARDS)]


def test_sizes_even_and_copies_together(spark):
    rows = [(i, cases.prose(40 + i % 50, i)) for i in range(400)] + [(1000 + 10 * g + k, cases.prose(60, 900 + g)) for g in range(30) for k in range(2 + g % 4)]
    got = S.balanced_shards(cases.documents(spark, rows)).collect()
    sizes = checked(rows, got)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / S.SHARDS
    by = {}
    text = dict(rows)
    for r in got:
        if r.doc_id >= 1000:
            by.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in by.values())


def test_a_group_larger_than_a_shard_is_split_evenly(spark):
    rows = [(i, cases.BASE) for i in range(300)] + [(1000 + i, cases.prose(60, i)) for i in range(100)]
    sizes = checked(rows, S.balanced_shards(cases.documents(spark, rows)).collect())
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / S.SHARDS


def test_awkward_rows(spark):
    checked(cases.ROWS, S.balanced_shards(cases.documents(spark)).collect())
    assert S.balanced_shards(cases.no_documents(spark)).count() == 0


def atoms_of(spark, groups):
    """Groups of single-row atoms of 10 bytes."""
    rows = [(f"g{g:04d}".encode(), k, 1, 10) for g, size in enumerate(groups) for k in range(size)]
    return spark.createDataFrame(rows, "link binary, atom long, n long, bytes long")


def test_rounds_lower_the_cut(spark):
    groups = [2 + g % 9 for g in range(120)] + [60]
    atoms = atoms_of(spark, groups)
    capacity = 10 * sum(groups) / 4
    cuts = [S.cut_edges(S.spread(atoms, 4)), *[S.cut_edges(S.propagate(atoms, 4, capacity, r).table) for r in (1, 12)]]
    start = {(r.link, r.atom): r.shard for r in S.spread(atoms, 4).collect()}
    by = {}
    for (link, _), shard in start.items():
        by.setdefault(link, []).append(shard)
    assert cuts[0] == sum(a != b for x in by.values() for i, a in enumerate(x) for b in x[:i])
    # every row is linked and every shard full from the start, so rows can only be exchanged
    assert cuts[0] > cuts[1] >= cuts[2] and cuts[2] < 0.35 * cuts[0]
    slack = S.propagate(atoms, 4, 2 * capacity)
    assert S.cut_edges(slack.table) < 0.02 * cuts[0]


def test_admission():
    # both ask for ten bytes of each other, shard 1 has room for four more
    asked = [(0, 1, 0, 6), (0, 1, 3, 4), (0, 1, 5, 4), (0, 1, 6, 9), (1, 0, 2, 10)]
    assert S.admitted(asked, [0.0, 4.0]) == {(0, 1): 5, (1, 0): 2}
    assert S.admitted(asked, [0.0, 0.0]) == {(0, 1): 3, (1, 0): 2}
    assert S.admitted(asked, [-5.0, -5.0]) == {(0, 1): 3, (1, 0): 2}
    # a level that does not fit stays, and then the other direction stays too
    assert S.admitted([(0, 1, 0, 7), (1, 0, 0, 5)], [0.0, 0.0]) == {}
    assert S.admitted([], [1.0, 1.0]) == {}


def test_quotas_hold_while_labels_move(spark):
    """One key of twice a shard's room: it fills shards up to their room and no further."""
    atoms = atoms_of(spark, [80, 40, 40])
    state = S.propagate(atoms, 4, 400.0)
    loads = {r.shard: r.b for r in state.table.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert sum(loads.values()) == 1600
    before = {r.shard: r.b for r in S.spread(atoms, 4).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert all(load <= max(400, before[s]) for s, load in loads.items())


def test_without_a_cut_every_key_is_whole(spark):
    state = S.propagate(atoms_of(spark, [2, 3, 4, 5] * 10), 4, 1e9)
    assert S.cut_edges(state.table) == 0.0


@pytest.mark.parametrize("loads, amount, want", [([0, 0], 10, [5, 5]), ([4, 0], 2, [0, 2]), ([4, 0, 1], 10, [1, 5, 4])])
def test_even_shares(loads, amount, want):
    assert S.even_shares(loads, amount) == want
