from collections import Counter
from itertools import combinations

import numpy as np

from terrane.llm import similarity as S
from tests.llm import cases


def brute(rows):
    sets = [set(S.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (i, t) in enumerate(rows):
        if sets[k]:
            ids.setdefault(top(k), []).append(i)
    least = {k: min([i for i in v if i is not None], default=None) for k, v in ids.items()}
    return sorted((repr(i), repr(least[top(k)] if sets[k] else i), links[k]) for k, (i, t) in enumerate(rows))


def result(df):
    return sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in df.collect())


def test_links_match_all_pairs(spark):
    assert result(S.Similarity(cases.documents(spark)).table()) == brute(cases.ROWS)


def test_chunks_of_a_large_group_lose_no_link(spark, monkeypatch):
    rows = [(i, cases.changed(cases.BASE, i)) for i in range(60)]
    monkeypatch.setattr(S, "CHUNK", 7)
    found = S.Similarity(cases.documents(spark, rows))
    assert result(found.table()) == brute(rows)
    pairs = found.pairs().collect()
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) == 60 * 59 // 2


def test_one_row_of_a_group_stays(spark):
    docs = cases.documents(spark)
    kept = S.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 10, 20, 22, 30, 31, 32, 33, 34]
    assert ids.count(None) == 2  # one of two equal texts, and the null text


def test_empty_table(spark):
    assert S.Similarity(cases.no_documents(spark)).table().count() == 0
    assert S.without_near_duplicates(cases.no_documents(spark)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = S.least_matches()
    assert all(0 < m < 0.8 * n for m, n in zip(least, range(S.STEP, S.HASHES + 1, S.STEP)))
    rng = np.random.default_rng(0)
    matches = rng.random((20_000, S.HASHES)) < 0.8
    for k, m in enumerate(least):
        assert (matches[:, :(k + 1) * S.STEP].sum(axis=1) >= m).mean() > 0.999


def test_min_hashes_estimate_similarity():
    a, b = S.shingles(cases.LONG), S.shingles(cases.prose(30_000, 9, 10**6))
    assert (S.min_hashes(a) == S.min_hashes(b)).mean() < 0.05
    c = np.union1d(a[:20_000], b[:10_000])
    d = np.union1d(a[:20_000], b[10_000:20_000])
    assert abs((S.min_hashes(c) == S.min_hashes(d)).mean() - 0.5) < 0.15
