"""Substring dedup by super-k-mers: words inside a window of 35 words that also starts elsewhere go.

The minimiser of a window is its leftmost smallest 8-word hash; consecutive windows with the same minimiser place
form a super-k-mer. Equal windows have equal minimisers, so first only minimiser values are counted: a super-k-mer whose value
occurs once holds no repeated window and stays where it is. The others travel, each as one packed string of
its words, to the bucket of their minimiser, where their windows are sorted and equal neighbours are repeats.

Equal texts travel as one: their windows all repeat. A minimiser that occurs too often for one bucket is dealt out by
window: each of its windows travels as a digest with a salt, as many salts as the minimiser fills buckets. A window met twice
under one salt is a repeat; only those met once are compared over all salts, by partial counts and a join.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from xxhash import xxh3_64_intdigest

from terrane.llm.common import runs, table, text_key
from terrane.session import Stored

WINDOW = 35
MINIMISER = 8
#: Super-k-mers of one minimiser that a bucket or a salt takes; those of a more frequent one are dealt out by window.
BUCKET = 4096
_BLOCK = 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def super_kmers(words: list[bytes], window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser value) of each run of windows with the same minimiser place."""
    count = len(words) - window + 1
    if count < 1:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    g = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        g = _mixed(g * _STEP + h[k:len(words) - size + 1 + k])
    inside = window - size + 1
    place = np.empty(count, np.int64)
    for s in range(0, count, _BLOCK):
        e = min(count, s + _BLOCK)
        view = np.lib.stride_tricks.sliding_window_view(g[s:e + inside - 1], inside)
        place[s:e] = view.argmin(axis=1) + np.arange(s, e)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    length = np.diff(np.append(first, count))
    return first.astype(np.int32), length.astype(np.int32), g[place[first]].view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, first, length, value = [], [], [], []
        for text in b.column("text").to_pylist():
            words = _words(text)
            f, c, v = super_kmers(words)
            n.append(len(words))
            first.append(f)
            length.append(c)
            value.append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int32())), pa.array(length, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.int64()))],
            names=["key", "n_words", "first", "length", "value"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed super-k-mers that travel; those of frequent minimisers as one digest per window."""
    before = None
    names = ["value", "key", "first", "packed", "digest", "salt"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        size = 0
        for key, text, live in zip(*(b.column(c).to_pylist() for c in ("key", "text", "live"))):
            if key == before:  # the next copy of a text
                continue
            before = key
            words = _words(text)
            for m in live:
                s, e = m["first"], m["first"] + m["length"]
                if m["salts"] > 1:
                    salt = zlib.crc32(key) % m["salts"]
                    new = [(m["value"], key, i, None, hashlib.blake2b(b" ".join(words[i:i + WINDOW]), digest_size=16).digest(), salt) for i in range(s, e)]
                else:
                    new = [(m["value"], key, s, b" ".join(words[s:e + WINDOW - 1]), None, None)]
                for r in new:
                    for column, x in zip(rows, r):
                        column.append(x)
                    size += len(r[3] or r[4])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                rows, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, low, high): words covered by the repeated windows of each bucket, found by sorting its windows."""
    for _, t in runs(batches, "value"):
        if t.num_rows < 2:
            continue
        packed = [p.split(b" ") for p in t.column("packed").to_pylist()]
        windows = sorted((b" ".join(w[i:i + WINDOW]), r, i) for r, w in enumerate(packed) for i in range(len(w) - WINDOW + 1))
        found = []
        for _, same in groupby(windows, key=lambda w: w[0]):
            same = [w[1:] for w in same]
            if len(same) > 1:
                found += same
        if not found:
            continue
        key, first = t.column("key"), t.column("first").to_pylist()
        out: list[list] = []
        for r, i in sorted(found):
            low = first[r] + i
            if out and out[-1][0] == r and low <= out[-1][2]:
                out[-1][2] = low + WINDOW
            else:
                out.append([r, low, low + WINDOW])
        yield pa.RecordBatch.from_arrays(
            [key.take(pa.array([r for r, _, _ in out], pa.int64())).combine_chunks(), pa.array([s for _, s, _ in out], pa.int64()), pa.array([e for _, _, e in out], pa.int64())],
            names=["key", "low", "high"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, kept = [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            words = _words(text)
            gone = np.zeros(len(words), bool)
            for s in spans or ():
                gone[s["low"]:s["high"]] = True
            n.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def _sent(plain: DataFrame, live: DataFrame) -> DataFrame:
    """The super-k-mers that travel. A merge join at any size: only rows sorted by key have copies as neighbours."""
    return plain.join(live.hint("merge"), "key").select("key", "text", "live").mapInArrow(
        _packed, "value long, key binary, first int, packed binary, digest binary, salt int")


def without_repeated_windows(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, ``kept`` (the words left, joined by one space).

    Windows are judged on the input. Null and empty texts, and texts under 35 words, lose nothing; of equal texts every
    one loses all. Only doc_id and text are read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    plain = docs.select("doc_id", "text", text_key("text").alias("key"))
    found = plain.where("key is not null").select("key", "text").mapInArrow(_minimisers, "key binary, n_words long, first array<int>, length array<int>, value array<long>")
    found = Stored(found).table.where(F.col("n_words") >= WINDOW)
    texts = found.groupBy("key").agg(F.any_value("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"),
                                     F.any_value(F.arrays_zip("first", "length", "value")).alias("m"))
    texts = Stored(texts).table
    every = texts.select("key", F.explode("m").alias("m")).select("key", "m.*")
    # tables that a hot key joins with are written first: then only plain exchanges meet, and a hot partition can be split
    often = Stored(every.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).table
    live = every.join(often, "value").groupBy("key").agg(
        F.collect_list(F.struct("first", "length", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("salts"))).alias("live"))
    sent = Stored(_sent(plain, Stored(live).table)).table

    bucket = sent.where("digest is null").select("value", "key", "first", "packed").repartition(F.col("value")).sortWithinPartitions("value")
    spans = bucket.mapInArrow(_repeated, "key binary, low long, high long")
    dealt = sent.where("digest is not null").select("digest", "salt", "key", F.col("first").cast("long").alias("low"))
    dealt = dealt.withColumn("met", F.count(F.lit(1)).over(W.partitionBy("digest", "salt")))
    twice = dealt.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    once = dealt.where("met = 1").join(twice, "digest", "left_semi")
    spans = spans.unionByName(dealt.where("met > 1").unionByName(once).select("key", "low", (F.col("low") + WINDOW).alias("high")))
    spans = spans.unionByName(texts.where("copies > 1").select("key", F.lit(0).cast("long").alias("low"), F.col("n_words").alias("high")))
    spans = Stored(spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))).table
    return plain.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op2_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = without_repeated_windows(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), place AS (
  SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)
), twice AS (SELECT win FROM place GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM place SEMI JOIN twice USING (win)),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS s FROM (
    SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
