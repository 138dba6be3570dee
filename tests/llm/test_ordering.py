from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import zlib
from pyspark.sql import functions as F

from terrane.llm import ordering as O
from terrane.llm.tokens import rank_encoder
from tests.llm import cases

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 257, 70_001])
def test_slots_are_a_permutation(n):
    a, b = (O.slots(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a.tolist()) == list(range(n)) and (n < 17 or (a != b).any())


def test_shards_hold_every_document_once(spark, tmp_path):
    rows = O.materialise(cases.documents(spark), f"file:{tmp_path}", VOCABULARY, length=64, per_shard=50).toPandas().sort_values("slot")
    n = len(rows)
    assert rows.slot.tolist() == list(range(n)) and sorted(rows.sequence_id) == list(range(n))
    read = list(O.read_sequences(str(tmp_path), 0, n, 64, 50))
    assert [zlib.crc32(r[:k].tobytes()) for r, k in zip(read, rows.n_tokens)] == rows.ids_crc32.tolist()
    again = list(O.read_sequences(str(tmp_path), 123, 10**9, 64, 50))
    assert len(again) == n - 123 and all((a == b).all() for a, b in zip(again, read[123:]))
    stream = np.concatenate([read[s][:k] for s, k in rows.sort_values("sequence_id")[["slot", "n_tokens"]].values])
    decode = rank_encoder(VOCABULARY, P.PATTERN).decode
    got = Counter(decode(x[:-1].tolist()) for x in np.split(stream, np.flatnonzero(stream == O.END_ID) + 1)[:-1])
    assert got == Counter(t or "" for _, t in cases.ROWS)


def test_no_documents(spark, tmp_path):
    assert O.materialise(cases.no_documents(spark), f"file:{tmp_path}/none", VOCABULARY).count() == 0


def test_registered_query_places_1024_tokens_of_its_vocabulary(spark, tmp_path):
    text = cases.prose(1500, 73)
    spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = O.op5_feistel_training_order(spark, str(tmp_path)).orderBy("sequence_id").collect()
    ids = np.array([*rank_encoder(VOCABULARY, P.PATTERN).encode_ordinary(text), O.END_ID], "<u2")
    want = [ids[s:s + 1024] for s in range(0, len(ids), 1024)]
    assert len(want) > 2
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(x.tobytes())) for x in want]


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(10,0)", "date"])
def test_kinds_of_ids(spark, tmp_path, kind):
    docs = cases.documents(spark, [(None, "x"), (3, cases.BASE), (4, "y")])
    one = F.expr("date_add(DATE'2020-01-01', cast(doc_id as int))") if kind == "date" else F.col("doc_id").cast(kind)
    docs = docs.withColumn("doc_id", one)
    rows = O.materialise(docs, f"file:{tmp_path}", VOCABULARY, length=64, per_shard=5)
    assert dict(rows.dtypes)["doc_ids"] == f"array<{kind}>"
    assert {i for r in rows.collect() for i in r.doc_ids} == {r.doc_id for r in docs.collect()}
