import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrane.llm import lattice as L
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = L.Vocabulary([" a", " ab", "b", "bc", "c", "a", "ab", "é"], np.log(np.append(np.array([8, 4, 2, 2, 1, 1, 1, 1]) / 32, [1 / 512] * 256 + [0.125])))


def cuts_of(word: str, known: L.Vocabulary):
    """Every sequence of pieces that spells a word, one by one."""
    if not word:
        yield ()
        return
    for i, p in enumerate(known.pieces):
        if word.startswith(p):
            for rest in cuts_of(word[len(p):], known):
                yield (i, *rest)
    for rest in cuts_of(word[1:], known):
        yield (*[known.bytes_at + b for b in word[0].encode()], *rest)


@pytest.mark.parametrize("word", ["a", "abc", "abcab", "cab", "éab", "x", "日a", "aaaa"])
def test_all_cuts_are_summed(word):
    lattice = L.Lattice(SMALL, SMALL.weights)
    cuts = list(cuts_of(" " + word, SMALL))
    p = np.exp(SMALL.weights)
    each = [math.prod(p[i] for i in cut) for cut in cuts]
    assert lattice.log_probabilities([b"zz", word.encode(), L.END])[1] == pytest.approx(math.log(sum(each)), abs=1e-12)
    want = Counter()
    for cut, q in zip(cuts, each):
        for i in cut:
            want[i] += q / sum(each)
    got = lattice.expected([word.encode(), b"unused", L.END], [3, 0, 2], 1 << 40) / (1 << 40)
    assert got[SMALL.end_at] == 2.0
    assert {*np.flatnonzero(got).tolist()} - {SMALL.end_at} <= set(want)
    for i, n in want.items():
        assert got[i] == pytest.approx(3 * n, abs=1e-10)


def test_batches_and_levels(monkeypatch):
    known = L.vocabulary(PATH)
    lattice = L.Lattice(known, known.weights)
    words = [w.encode() for w in cases.prose(200, 1).split()] + [L.END, b"z" * 5000, "日本語".encode(), "▁a▁".encode()]
    whole = lattice.log_probabilities(words)
    monkeypatch.setattr(L, "LETTERS", 10)
    assert whole == pytest.approx(lattice.log_probabilities(words), abs=1e-9)
    assert whole == pytest.approx([lattice.log_probabilities([w])[0] for w in words], abs=1e-9)


def test_weights_are_a_distribution():
    known = L.vocabulary(PATH)
    assert np.exp(known.weights).sum() == pytest.approx(1.0)
    assert len(set(known.pieces)) == len(known.pieces) and not any(" " in p[1:] for p in known.pieces)
    new = L.learned(known, {3: 10.0, known.end_at: 5.0})
    assert np.exp(new).sum() == pytest.approx(1.0) and new[3] > known.weights[3]


def test_no_more_than_one_in_all():
    """Texts of up to two words of up to three letters, over a vocabulary of two letters, share less than one."""
    tiny = L.Vocabulary([" a", "b", "ab"], np.log(np.append([0.3, 0.2, 0.2], [0.1 / 256] * 256 + [0.2])))
    lattice = L.Lattice(tiny, tiny.weights)
    words = [a for n in (1, 2, 3) for a in map("".join, __import__("itertools").product("ab", repeat=n))]
    one = np.exp(lattice.log_probabilities([w.encode() for w in words])).sum()
    assert 0.05 < (1 + one + one ** 2) * math.exp(tiny.weights[-1]) < 1


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def brute_force(rows):
    """Counts by plain loops, pieces weighed by all cuts at once in probabilities instead of logs."""
    known = L.vocabulary(PATH)
    ids = {p: i for i, p in enumerate(known.pieces)}
    longest = max(map(len, ids))
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            count.update([*words_of(t), None])
    n, v = sum(count.values()), len(count)

    def arcs(word):
        for s in range(len(word)):
            yield s, s + 1, [known.bytes_at + b for b in word[s].encode()]
            for e in range(s + 1, min(len(word), s + longest) + 1):
                if word[s:e] in ids:
                    yield s, e, [ids[word[s:e]]]

    def forward(word, p):
        a = [1.0] + [0.0] * len(word)
        for s, e, used in arcs(word):
            a[e] += a[s] * math.prod(p[i] for i in used)
        return a

    p = np.exp(known.weights)
    expected = np.exp(known.weights) * len(known.weights)
    for word, c in count.items():
        if word is None:
            expected[known.end_at] += c
            continue
        word = " " + word
        a = forward(word, p)
        b = [0.0] * len(word) + [1.0]
        for s, e, used in sorted(arcs(word), key=lambda x: -x[0]):
            b[s] += b[e] * math.prod(p[i] for i in used)
        for s, e, used in arcs(word):
            for i in used:
                expected[i] += c * a[s] * math.prod(p[j] for j in used) * b[e] / a[-1]
    p = expected / expected.sum()

    @lru_cache(None)
    def log_p(word):
        return math.log10(p[known.end_at] if word is None else forward(" " + word, p)[-1])

    out = []
    for (i, t), h in zip(rows, held):
        tokens = [*words_of(t), None]
        out.append((i, h, len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), sum(map(log_p, tokens))))
    return out


@pytest.mark.parametrize("head", [1, 40, L.HEAD])
def test_rows_against_brute_force(spark, head):
    rows = [(i, t) for i, t in cases.ROWS if t != cases.LONG] + [(k, cases.prose(30, k, 50).title() + " naïve İ▁x \x1f 日本") for k in range(100, 160)]
    docs = cases.documents(spark, rows)
    found = L.score(docs, L.training(), PATH, head=head)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted([(r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()], key=order)
    want = sorted(brute_force(rows), key=order)
    assert any(h for _, h, *_ in want) and not all(h for _, h, *_ in want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-10)
        assert a[6] == pytest.approx(b[6], rel=1e-6)  # expected counts are rounded


def test_long_texts_and_words(spark, monkeypatch):
    text = " ".join(["ab cd"] * 50_000) + " " + "x" * 300_000
    docs = spark.createDataFrame([(1, text), (2, "ab cd")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.score(docs, F.lit(True), PATH).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens) == (100_002, 100_002, 100_005)
    assert math.isfinite(got[1].score) and got[1].score < got[2].score < 0
    monkeypatch.setattr(L, "BLOCK", 7)
    assert L.counted(" a bb\tccc  dddd eeeee A ") == {b"a": 2, b"bb": 1, b"ccc": 1, b"dddd": 1, b"eeeee": 1, L.END: 1}


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark)
    for r in L.score(docs, F.lit(False), PATH).collect():
        assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0
    assert L.score(cases.no_documents(spark), L.training(), PATH).count() == 0


def test_prose_is_likelier_than_shuffled_letters(spark):
    """On held-out rows: the learned pieces beat the vocabulary's own weights, and words beat the same letters shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda df: df.where("not train").agg(F.sum("score"), F.sum("n_tokens")).first()
    learned, tokens = held(L.score(docs, L.training(), PATH))
    plain, _ = held(L.score(docs, L.training(), PATH, rounds=0))
    assert tokens > 10_000 and learned > plain
    # the mark keeps the split of the rows: ids are the same, only training rows differ from held-out ones
    turned = docs.withColumn("text", F.when(L.training(), F.col("text")).otherwise(F.array_join(F.transform(F.split("text", " "), F.reverse), " ")))
    assert held(L.score(turned, L.training(), PATH))[0] < learned
