import numpy as np

import corpus_pipeline
from terrane.llm import decontamination, pii, rules, similarity
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operator_keeps(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == first.columns
        seen.append((name, docs, out))
        docs = spark.createDataFrame(out.toPandas(), first.schema)
    ids = [{r.doc_id for r in out.select("doc_id").collect()} for _, _, out in seen]
    (_, d0, _), (_, d1, _), (_, d2, _), (_, d3, out3) = seen
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids[0] == {r.doc_id for r in rules.judged(d0, rules.learn_rules(d0, labels)).where("kept").collect()}
    assert ids[1] == {r.class_id for r in similarity.Similarity(d1).table().collect()}
    assert ids[2] == {r.doc_id for r in decontamination.contamination(d2, items).where("not contaminated").collect()}
    assert ids[3] == ids[2]
    masked = {r.doc_id: r.text for r in out3.collect()}
    for r in d3.collect():
        assert masked[r.doc_id] == pii.redact(r.text, pii.find(r.text))
        assert not [s for s in pii.find(masked[r.doc_id]) if s[0] in pii.BASE]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == ids[3]
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    assert packed.length.sum() > 0.9 * 4096 * packed.sequence_id.nunique() and np.all(packed.length > 0)


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (cases.documents(spark), cases.no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
