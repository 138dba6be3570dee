"""Language identification with error-correcting output codes over character n-grams.

Every language has a codeword; a binary classifier for each bit tells the languages with that bit set from the others by
hashed 1- to 3-grams of letters. The classifiers come from n-gram counts of all learning rows, summed in Spark, so
what the driver holds is languages x buckets numbers. A text's margins are decoded to the codeword with the smallest
weighted loss; the weights are how often a bit is right for a language, on a bounded sample of learning rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import table

BUCKETS = 1 << 14
ORDERS = 3
UNKNOWN = "und"
MAX_LANGUAGES = 500
SAMPLE = 4000        # learning rows on which the bits are weighed
SMOOTHING = 0.5
AMBIGUOUS = 0.75     # a score below this flags the text


@lru_cache(1)
def _letters() -> np.ndarray:
    """1 for the letters of the first plane."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text, anything but letters read as blanks; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    low = c < 0x10000
    letter = np.where(low, _letters()[np.where(low, c, 0)], False)
    if not low.all():
        letter[~low] = [chr(x).isalpha() for x in c[~low].tolist()]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(c), np.uint32)
    for k in range(ORDERS):
        h = h[:len(c) - k] * np.uint32(0x01000193) + c[k:] * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        if len(h):
            counts += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), minlength=BUCKETS)
    return counts


def codewords(languages: int, seed: int = 4) -> np.ndarray:
    """One row of +1 and -1 for each language: all splits for few languages, else the best of random codes."""
    if languages <= 7:
        bits = max(1, 2 ** (languages - 1) - 1)
        code = [[1] * bits] + [[1 if b >> (k - 1) & 1 else -1 for b in range(bits)] for k in range(1, languages)]
        return np.array(code)
    rng, best = np.random.default_rng(seed), None
    for _ in range(100):
        code = rng.choice([-1, 1], size=(languages, 63))
        near = ((63 - code @ code.T) // 2 + 64 * np.eye(languages, dtype=int)).min()
        if (np.abs(code.sum(axis=0)) < languages).all() and (best is None or near > best[0]):
            best = (near, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # bits x buckets
    trust: np.ndarray     # languages x bits, rows sum to 1

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit over the n-grams, scaled so that long texts are decided sharply."""
        used = np.flatnonzero(counts)
        n = counts[used].sum()
        return (self.weights[:, used] @ counts[used]) / n * min(float(n), 400.0) ** 0.5

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        loss = (self.trust * np.logaddexp(0.0, -self.code * margins)).sum(axis=1) * 2.0
        share = np.exp(-(loss - loss.min()))
        best = int(loss.argmin())
        return self.languages[best], float(share[best] / share.sum())


def held_out() -> Column:
    """Rows that are kept for judging: crc32 of the id as text, mod 4, is 2 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            counts = grams(text)
            if counts is not None:
                sums[lang] = sums[lang] + counts if lang in sums else counts
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])


def _margins(model: Model):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [None if (c := grams(t)) is None else model.margins(c).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(found, pa.list_(pa.float64()))], names=["lang", "margins"])
    return batches


def learn(rows: DataFrame) -> Model | None:
    """Model of the ``lang`` values of ``rows``; rows without language or without a letter teach nothing."""
    rows = rows.where("lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sums = rows.select("text", "lang").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = sums.limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return None
    row = {x: i for i, x in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    counts[[row[x] for x in got.column("lang").to_pylist()], got.column("gram").to_numpy()] += got.column("n").to_numpy()
    shares = counts / counts.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = np.zeros((bits, BUCKETS), np.float32)
    for b in range(bits):
        yes, no = shares[code[:, b] > 0], shares[code[:, b] < 0]
        if len(no):
            weights[b] = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0))
    model = Model(languages, code, weights, np.full(code.shape, 1.0 / bits))
    # how often each bit is right for each language, on a bounded sample
    total = rows.count()
    part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(int(min(1.0, SAMPLE / max(total, 1)) * 1_000_000)))
    tried = part.select("text", "lang").mapInArrow(_margins(model), "lang string, margins array<double>").where("margins is not null")
    right = tried.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("margins")[b] > 0).cast("int")).alias(f"b{b}") for b in range(bits)])
    trust = np.ones(code.shape)
    for r in right.collect():
        positive = np.array([r[f"b{b}"] for b in range(bits)])
        trust[row[r.lang]] = (np.where(code[row[r.lang]] > 0, positive, r.n - positive) + 1.0) / (r.n + 2.0)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, ambiguous. A text that is null or has no letter is ``und`` with score 0.

    Whole texts are read; other columns than doc_id and text are not. Equal texts get equal results.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = []
            for text in b.column("text").to_pylist():
                counts = grams(text) if model else None
                found.append((UNKNOWN, 0.0) if counts is None else model.decode(model.margins(counts)))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
                pa.array([s < AMBIGUOUS for _, s in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")


def op4_output_code_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
