import hashlib
import re

from terrane.llm import decontamination as D
from tests.llm import cases


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1)):
            if w and item is not None:
                windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, ids = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[tuple(w[i:i + size])]
        out.append((repr(doc), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(1, cases.prose(25, 70)), (2, "the SHORT item"), (3, None), (4, "..."), (10, " ".join(cases.BASE.split(" ")[50:70])), (11, " ".join(cases.BASE.split(" ")[55:75])),
         (12, "É über Éa"), (None, "no id here"), (2, "the SHORT item"), (13, "a a a a a a a a a a a")]
ROWS = cases.ROWS + [
    (60, "xx The short, ITEM yy"), (61, "the short"), (62, f"{cases.prose(20, 71)} {cases.prose(25, 70)}"), (63, " ".join(cases.prose(25, 70).split(" ")[3:13])),
    (64, " ".join(cases.prose(25, 70).split(" ")[3:12])), (65, "x É ÜBER Éa É über Éa"), (66, "the short item the short item"), (67, "a " * 30)]


def test_hits_match_all_windows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(cases.documents(spark, ROWS), items).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(ROWS, ITEMS)


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    test_hits_match_all_windows(spark)


def test_clean_rows_stay(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = cases.documents(spark, ROWS)
    kept = D.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in brute(ROWS, ITEMS) if not x[5])


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(cases.no_documents(spark), items).count() == 0
    got = D.contamination(cases.documents(spark), items.where("item_id = -1")).collect()
    assert len(got) == len(cases.ROWS) and not any(r.contaminated for r in got)


def test_items_without_an_id_are_searched(spark):
    passage = cases.prose(12, 72)
    items = spark.createDataFrame([(None, passage), (None, "zz one zz two"), (7, "zz one zz two")], "item_id long, text string")
    rows = [(1, f"before {passage} after"), (2, "zz one zz two"), (3, "none of them"), (4, f"{passage} zz one zz two")]
    docs = cases.documents(spark, rows)
    got = {r.doc_id: tuple(r)[1:] for r in D.contamination(docs, items).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (14, 12, 1, sha(""), True), 2: (4, 4, 2, sha("7"), True), 3: (3, 0, 0, sha(""), False), 4: (16, 16, 2, sha("7"), True)}
    assert [r.doc_id for r in D.without_contaminated(docs, items).collect()] == [3]


def test_items_without_an_id_match_the_sql(spark):
    import duckdb

    passage = cases.prose(12, 72)
    bench = [(None, passage), (None, "zz one zz two"), (7, "zz one zz two")]
    rows = [(1, f"before {passage} after"), (2, "zz one zz two"), (3, "none of them"), (4, f"{passage} zz one zz two")]
    db = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", bench)):
        db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, D.contamination(cases.documents(spark, rows), items).collect())) == sorted(db.execute(D.OP9_SQL).fetchall())
