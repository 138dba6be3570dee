import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from terrane.llm import packing as K
from terrane.llm.tokens import encoder
from tests.llm import cases

VOCABULARY = P.path("word_bpe_49k.json")


def test_encoder_equals_the_library():
    tok, own = Tokenizer.from_file(VOCABULARY), encoder(VOCABULARY)
    odd = ["<|endoftext|> a", "İstanbul ΣΑΣ", "é x y", "a\x85b", "don't 'S x''ll!!'s we've", "ａ１２", "日本 語 ²³ ª", " ", "", "\x1c a", "ﬁ ŒŠ", "ÀÉ×ß µ", "é", "a\xadb", "1234 5.6"]
    r = random.Random(5)
    odd += ["".join(r.choice("aÉ'sltveTm 1²!.\n\t<|ß") for _ in range(30)) for _ in range(300)]
    for t in [*odd, cases.LONG]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def packed(spark, docs, length):
    rows = K.pack(docs, VOCABULARY, length=length).toPandas()
    for _, x in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert x.offset.tolist() == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= length
    assert sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique()))
    return rows


def test_every_id_lies_in_one_piece(spark):
    rows = packed(spark, cases.documents(spark), 512)
    tok = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t in cases.ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 512):
            part = ids[s:s + 512]
            want[repr(i), s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = Counter((repr(None if r.doc_id != r.doc_id else int(r.doc_id)), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.itertuples())
    assert got == want


def test_little_padding(spark):
    rows = packed(spark, cases.documents(spark, [(i, cases.prose(20 + 7 * i % 300, i)) for i in range(400)]), 4096)
    assert rows.length.sum() > 0.97 * 4096 * rows.sequence_id.nunique()


def test_no_documents(spark):
    assert K.pack(cases.no_documents(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_every_rest_as_well_as_first_fit(seed):
    r = random.Random(seed)
    counts = {s: r.randrange(1, 400) for s in r.sample(range(1, 513), 60)}
    found = K.patterns(counts, 512)
    held = Counter()
    for n, inside in found:
        assert sum(s * a for s, a in inside.items()) <= 512
        for s, a in inside.items():
            held[s] += n * a
    assert held == Counter(counts)
    rooms = []  # first fit, largest first
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= s), None)
        if k is None:
            rooms.append(512 - s)
        else:
            rooms[k] -= s
    used = sum(n for n, _ in found)
    assert sum(s * n for s, n in counts.items()) / 512 <= used <= len(rooms) + 3


def test_knapsack_finds_the_best_pattern():
    worth, inside = K.best_pattern(np.array([0.3, 0.5, 0.9]), np.array([2, 3, 5]), 10)
    assert abs(worth - 1.8) < 1e-9 and inside == Counter({2: 2})
    assert K.patterns({}, 512) == []


def test_little_padding_of_short_documents(spark):
    empty = packed(spark, cases.documents(spark, [(i, None if i % 2 else "") for i in range(1200)]), 512)
    assert len(empty) == 1200 and empty.sequence_id.nunique() == 3
    short = packed(spark, cases.documents(spark, [(i, " ".join("a" * (i % 20))) for i in range(1500)]), 512)
    assert len(short) == 1500 and short.sequence_id.nunique() <= -(-short.length.sum() // 512) + 1


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_rest(seed):
    r = random.Random(seed)
    counts = {s if s <= K.SHORT else -(-s // 8) * 8: r.randrange(1, 300) for s in r.sample(range(1, 4096), 90) + r.sample(range(1, 129), 30)}
    table, used = K.plan(counts, 4096, 8)
    seen, filled = {c: [] for c in counts}, Counter()
    for x in table.to_pylist():
        for rank in range(x["low"], x["high"]):
            seen[x["cls"]].append(rank)
            filled[x["first"] + (x["skip"] + (rank - x["low"]) // x["per"]) // x["each"]] += x["cls"]
    assert all(sorted(seen[c]) == list(range(n)) for c, n in counts.items())
    assert sorted(filled) == list(range(used)) and max(filled.values()) <= 4096
