import numpy as np
from pyspark.sql import functions as F

from terrane.llm import langid as L
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = L.op4_output_code_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.where("score < 0 or score > 1").count() == 0


def test_awkward_rows(spark):
    docs = cases.documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 3 == 0, "de"))
    found = {r.doc_id: r for r in L.identify(docs, L.learn(docs)).collect()}
    assert len(found) == len({i for i, _ in cases.ROWS}) and found[20].lang_pred in ("en", "de")
    for i in (1, 2, 3):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    digits = spark.createDataFrame([(1, "12 34 !", "en")], "doc_id long, text string, lang string")
    assert L.identify(digits, L.learn(docs)).first().lang_pred == "und"


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(docs, L.learn(docs)).collect()} == {"und"}
    assert L.identify(cases.no_documents(spark), L.learn(cases.no_documents(spark))).count() == 0
    one = L.learn(cases.documents(spark))
    assert {r.lang_pred for r in L.identify(cases.documents(spark), one).collect()} == {"en", "und"}


def test_codewords_differ_and_bits_split():
    for n in (2, 3, 4, 7, 8, 40):
        code = L.codewords(n)
        assert (np.abs(code.sum(axis=0)) < n).all()
        distance = (code.shape[1] - code @ code.T) // 2
        assert (distance + 99 * np.eye(n, dtype=int)).min() >= (code.shape[1] + 1) // 4


def test_one_wrong_bit_is_corrected():
    code = L.codewords(4)
    model = L.Model(list("abcd"), code, np.zeros((7, 1)), np.full(code.shape, 1 / 7))
    for k in range(4):
        for b in range(7):
            margins = 3.0 * code[k]
            margins[b] = -margins[b]
            assert model.decode(margins)[0] == "abcd"[k]
