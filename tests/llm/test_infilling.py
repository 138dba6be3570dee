import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from terrane.llm import infilling as I
from tests.llm import cases

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_offsets(text):
    return [0, *[m.end() for m in UNIT.finditer(text)]]


def members(text):
    found = I.boundaries(text)
    return [found.select(k) for k in range(len(found))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1f\xa0ab \U0001f600", max_size=40))
def test_boundaries_are_unit_ends(text):
    assert members(text) == plain_offsets(text)


def test_boundaries_around_the_ends_of_containers():
    for n in (I.SPAN - 1, I.SPAN, I.SPAN + 1, 2 * I.SPAN):
        for text in ("a" * n, " " * n, "a " * (n // 2), "a" * (n - 1) + " ", "a" * (n - 1) + " b", " " * (n - 1) + "a", "\U0001f600" * n + " x"):
            assert members(text) == plain_offsets(text)


def test_forms_of_containers_agree():
    r = np.random.default_rng(1)
    seen = set()
    for values in (np.array([0]), np.array([5, 9, 65535]), np.arange(70, 60_000), np.sort(r.choice(I.SPAN, 40_000, replace=False)),
                   np.arange(0, I.SPAN, 2), np.concatenate([np.arange(0, 900), np.arange(50_000, I.SPAN)])):
        part = I.container(values)
        seen.add(type(part).__name__)
        assert [part.select(k) for k in range(0, len(values), 7)] == values[::7].tolist()
        forms = [I.ArrayPart(values), I.BitmapPart(values), part]
        assert part.nbytes == min(f.nbytes for f in forms)
        for f in forms:
            assert f.select(len(values) - 1) == values[-1] and f.select(0) == values[0]
    assert seen == {"ArrayPart", "BitmapPart", "RunPart"}


def brute_force(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_rows_against_brute_force(spark):
    r = random.Random(3)
    rows = [*cases.ROWS, *[(1000 + k, "".join(r.choice(["a", "<", "P>", "<S", ">", " ", "\n", "é", "<M>"]) for _ in range(r.randrange(60)))) for k in range(400)]]
    docs = cases.documents(spark, rows)
    out = I.infill(docs)
    got = sorted(map(repr, ((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out.collect())))
    assert got == sorted(map(repr, ((i, *brute_force(i, t)) for i, t in rows)))
    assert {x.form for x in out.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    texts = sorted(t or "" for _, t in rows)
    assert sorted(x.text for x in out.select(I.restored(out.output, out.form).alias("text")).collect()) == texts


def test_empty_table(spark):
    assert I.infill(cases.no_documents(spark)).count() == 0
