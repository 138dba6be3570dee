import re
from collections import Counter

from pyspark.sql import functions as F

from terrane.llm import rules as R
from tests.llm import cases


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


EXTRA = [(50, "a b c a b c"), (51, "a a a a"), (52, "x\n\nx\n \nx#*|"), (53, "a b c d a b c"), (54, "\n".join(["# é | b"] * 30)), (55, "a b\x85c \xa0 d")]


def test_base_counts_and_verdict(spark):
    rows = cases.ROWS + EXTRA
    got = R.judged(cases.documents(spark, rows), []).collect()
    assert sorted((repr(r.doc_id), *(r[c] for c in R.BASE)) for r in got) == sorted((repr(i), *brute(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_rules_are_learned_and_applied(spark):
    good = [(2000 + i, cases.prose(100, i)) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in cases.prose(100, 500 + i).split(" "))) for i in range(60)]
    docs = cases.documents(spark, good + bad + cases.ROWS)
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in good] + [(i, 0, "x") for i, _ in bad] + [(None, 0, "x"), (5000, 0, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    rules = R.learn_rules(docs, labels)
    assert rules and rules[0].hits == rules[0].covered >= 50
    kept = R.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {i for i, _ in good} and not ids & {i for i, _ in bad} and not ids & {1, 2, 3, 4, 33, 34}


def test_nothing_to_learn_from(spark):
    docs, none = cases.documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert R.learn_rules(docs, none) == []
    assert R.learn_rules(docs, none.unionByName(docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))) == []
    assert R.quality_filter(cases.no_documents(spark), none).count() == 0


def test_sample_is_bounded(spark):
    docs = cases.documents(spark, [(i, "a b") for i in range(3000)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert 50 < R.labelled_sample(docs, labels, max_rows=100).count() < 200
