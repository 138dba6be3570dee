import hashlib
import re
from collections import Counter

import pytest

from terrane.llm import substring as S
from tests.llm import cases


def brute(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = Counter(tuple(w[i:i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - 34):
            if starts[tuple(w[i:i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((repr(doc), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("bucket", [4096, 1])
def test_removed_words_match_all_windows(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    assert result(S.without_repeated_windows(cases.documents(spark))) == brute(cases.ROWS)


def test_passage_shared_by_many_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 10)
    passage = cases.prose(60, 50)
    rows = [(i, f"{cases.prose(50, 100 + i)} {passage} {cases.prose(50, 200 + i)}") for i in range(40)]
    assert result(S.without_repeated_windows(cases.documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert S.without_repeated_windows(cases.no_documents(spark)).count() == 0


def test_super_kmers_hold_every_window_once():
    words = cases.prose(500, 11, 30).encode().split()
    first, length, value = S.super_kmers(words)
    assert first[0] == 0 and (first[1:] == first[:-1] + length[:-1]).all() and first[-1] + length[-1] == len(words) - 34
    # equal windows have equal minimisers
    by = {}
    for f, n, v in zip(first, length, value):
        for i in range(f, f + n):
            assert by.setdefault(tuple(words[i:i + 35]), v) == v


def test_copies_travel_once_whatever_the_size(spark):
    a, b = cases.prose(40, 60), cases.prose(40, 61)
    docs = spark.createDataFrame([(a,), (b,)] * 30, "text string").coalesce(1)
    plain = docs.select("text", S.text_key("text").alias("key"))
    live = plain.select("key").distinct().selectExpr("key", "array(named_struct('first', 0, 'length', 6, 'value', 7L, 'salts', 1)) AS live")
    assert S._sent(plain, S.Stored(live).table).count() == 2
