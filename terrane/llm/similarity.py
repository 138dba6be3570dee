"""N-gram Jaccard join: shingle sets, MinHash bands for candidates, Bayesian pruning, exact verification.

Documents with the same shingle set form a class, and only one text of a class goes on. A band bucket is known by its
*lead*, the smallest class prefix in it. Two classes that share a bucket share its lead, so a class travels
once for each distinct lead, not once a band, and every pair with a common bucket meets in a unit of its
lead. Inside a unit the MinHash values of all pairs are compared in steps; a pair goes when the posterior
probability of reaching the threshold falls below the tolerance; the shingle sets of the rest are intersected.
A lead with many members is split into chunks, and every pair of chunks is a unit of its own, so no unit holds
more than two chunks. Units return, for each class, how many rows its links lead to and one edge into its
group, so a group's pairs are counted but never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from xxhash import xxh3_64_intdigest

from terrane.llm.common import in_arrow, row_key, runs, table
from terrane.session import Stored

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5          # a pair at 0.8 misses all 32 bands of 5 rows with probability 3e-6
HASHES = BANDS * ROWS
STEP = 32                    # MinHash values compared before each posterior check
TOLERANCE = 1e-6
CHUNK = 512                  # members of a chunk
CHUNK_BYTES = 24 << 20       # text bytes of a chunk

_MULTIPLIERS = (np.random.default_rng(20).integers(1, 2**63, size=HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle values; a shorter text with words is one shingle."""
    w = (text or "").encode().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    s = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        s = _mixed(s * _STEP + h[k:len(w) - size + 1 + k])
    return np.unique(s)


def min_hashes(s: np.ndarray) -> np.ndarray:
    """HASHES values of a non-empty set, in blocks so that a long text needs no large matrix."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(low, (_MULTIPLIERS[:, None] * s[None, k:k + 1024]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache(None)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each step, the fewest matches with which a pair stays.

    With a uniform prior, P(J >= t | m of n values match) = P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for b in batches:
        keys, bands = [], []
        for text in b.column("text").to_pylist():
            s = shingles(text)
            if not len(s):
                keys.append(None)
                bands.append(None)
                continue
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            rows = min_hashes(s).reshape(BANDS, ROWS).astype(np.uint64)
            h = number.copy()
            for r in range(ROWS):
                h = _mixed(h * _STEP + rows[:, r])
            bands.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), b.column("size"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["row", "doc_id", "size", "cls", "bands"])


def _unit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int], list[tuple[int, int, int, int]]]]:
    """For each unit its rows, one row for each class, and the pairs (x, y, shared, total) of such rows that are links."""
    least = least_matches()
    for _, t in runs(batches, "unit"):
        seen: dict[tuple, int] = {}
        cols = {n: t.column(n).to_pylist() for n in ("cls", "lead", "chunk", "first", "second")}
        rows = [seen.setdefault((k, ld), i) for i, (k, ld) in enumerate(zip(cols["cls"], cols["lead"]))]
        at = [i for i, r in enumerate(rows) if r == i]
        if len(at) < 2:
            continue
        texts, leads = t.column("text"), t.column("leads")
        sets = [shingles(texts[i].as_py()) for i in at]
        own = [frozenset(leads[i].as_py()) for i in at]
        chunk = np.array([cols["chunk"][i] for i in at])
        sig = np.stack([min_hashes(s) for s in sets])
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flags = np.zeros(int(ids.max()) + 1, bool)
        found = []
        for x in range(len(at) - 1):
            i = at[x]
            lead = cols["lead"][i]
            ys = np.arange(x + 1, len(at))
            if cols["first"][i] != cols["second"][i]:  # two chunks: only pairs across them
                ys = ys[chunk[ys] != chunk[x]]
            matches = np.zeros(len(ys), np.int32)
            for k, m in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                matches += (sig[ys, part] == sig[x, part]).sum(axis=1, dtype=np.int32)
                stay = matches >= m
                ys, matches = ys[stay], matches[stay]
                if not len(ys):
                    break
            # a pair counts in the unit of its smallest common lead
            ys = [y for y in ys.tolist() if cols["lead"][at[y]] == lead and min(own[x] & own[y]) == lead]
            if not ys:
                continue
            flags[ids[starts[x]:starts[x + 1]]] = True
            for y in ys:
                shared = int(np.count_nonzero(flags[ids[starts[y]:starts[y + 1]]]))
                total = int(sizes[x] + sizes[y]) - shared
                if shared >= THRESHOLD * total - 1e-9:
                    found.append((x, y, shared, total))
            flags[ids[starts[x]:starts[x + 1]]] = False
        yield t, at, found


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at, found in _unit_pairs(batches):
        if found:
            cls = [t.column("cls")[i].as_py() for i in at]
            a, b = zip(*[sorted((cls[x], cls[y])) for x, y, _, _ in found])
            yield pa.RecordBatch.from_arrays([
                pa.array(a, pa.binary()), pa.array(b, pa.binary()), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)],
            ], names=["a", "b", "shared", "total"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each linked class of a unit: the rows its links lead to, and the smallest class it reaches here."""
    for t, at, found in _unit_pairs(batches):
        if not found:
            continue
        cls, copies = ([t.column(c)[i].as_py() for i in at] for c in ("cls", "copies"))
        far, root = dict.fromkeys({x for f in found for x in f[:2]}, 0), list(range(len(at)))

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y, _, _ in found:
            far[x] += copies[y]
            far[y] += copies[x]
            a, b = sorted((top(x), top(y)), key=lambda k: cls[k])
            root[b] = a
        yield pa.RecordBatch.from_arrays([
            pa.array([cls[x] for x in far], pa.binary()), pa.array([cls[top(x)] for x in far], pa.binary()), pa.array(list(far.values()), pa.int64()),
        ], names=["cls", "near", "far"])


class Similarity:
    """Classes, links and groups of a table of texts.

    ``rows``: row key, doc_id, class of every row (no class for null texts and texts without words).
    ``classes``: class, smallest doc_id, number of rows. Two classes with a Jaccard similarity of at least 0.8 are
    linked. Texts with the same shingle set, exact copies included, are one class. Extra columns are not read.
    """

    def __init__(self, docs: DataFrame):
        plain = docs.select(row_key().alias("row"), F.col("doc_id"), "text", F.octet_length("text").cast("long").alias("size"))
        kind = dict(plain.dtypes)["doc_id"]
        stored = Stored(in_arrow(plain, _class_rows, f"row binary, doc_id {kind}, size long, cls binary, bands array<long>")).table
        self.rows = stored.select("row", "doc_id", "cls")
        classed = stored.where("cls is not null")
        self.classes = classed.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        one = classed.groupBy("cls").agg(F.min_by(F.struct("row", "size", "bands"), "row").alias("o"), F.count(F.lit(1)).alias("copies"))
        bands = one.select("cls", "copies", "o.row", "o.size", F.explode("o.bands").alias("band"), F.xxhash64("cls").alias("prefix"))
        leads = bands.groupBy("band").agg(F.min("prefix").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        member = Stored(bands.join(leads, "band").select("cls", "copies", "row", "size", "lead").distinct()).table
        # a lead's chunks follow from its members and their bytes
        chunks = member.groupBy("lead").agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES)).cast("int").alias("chunks"))
        m = member.join(chunks, "lead")
        mine = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("chunks")).cast("int")
        per_class = m.groupBy("cls", "copies", "row").agg(
            F.collect_set("lead").alias("leads"), F.collect_list(F.struct("lead", mine.alias("chunk"), "chunks")).alias("at"))
        texts = plain.select("row", "text").join(per_class, "row")
        met = texts.select("cls", "copies", "text", "leads", F.explode("at").alias("m")).select("cls", "copies", "text", "leads", "m.*")
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = met.select("cls", "copies", "text", "leads", "lead", "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"))
        met = met.withColumn("unit", F.xxhash64("lead", "first", "second"))
        self._units = met.repartition(F.col("unit")).sortWithinPartitions("unit")

    def pairs(self) -> DataFrame:
        """(a, b, shared, total): every pair of linked classes with its shingle counts."""
        return in_arrow(self._units, _pairs, "a binary, b binary, shared long, total long")

    def linked(self) -> DataFrame:
        """(cls, near, far) for each unit: links as counts and as one edge a class, without listing pairs."""
        return Stored(in_arrow(self._units, _linked, "cls binary, near binary, far long")).table

    @staticmethod
    def groups(linked: DataFrame) -> DataFrame:
        """(cls, root): linked classes and the smallest class they reach, by label exchange and pointer jumps."""
        edges = linked.where("cls <> near").selectExpr("cls AS x", "near AS y").distinct()
        pairs = Stored(edges.unionByName(edges.selectExpr("y AS x", "x AS y")))
        state = Stored(pairs.table.groupBy("x").agg(F.min("y").alias("y")).selectExpr("x AS cls", "least(x, y) AS root"))
        while True:
            near = pairs.table.join(state.table.selectExpr("cls AS y", "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
            best = state.table.join(near.withColumnRenamed("x", "cls"), "cls").selectExpr("cls", "root", "least(root, near) AS best")
            jump = state.table.selectExpr("cls AS best", "root AS far")
            moved = best.join(jump, "best").selectExpr("cls", "least(best, far) AS root", "least(best, far) <> root AS changed")
            step = Stored(moved, {"n": F.sum(F.col("changed").cast("long"))})
            state.drop()
            state = step
            if not step.measures["n"]:
                pairs.drop()
                return state.table.select("cls", "root")

    def table(self) -> DataFrame:
        """One row per input row: ``row, doc_id, class_id, n_links``, and the ``root`` of its group (null without words).

        ``class_id`` is the smallest doc_id that links lead to; ``n_links`` counts the other rows
        with similarity 0.8 or more. A row without words has no links and its own id.
        """
        linked = self.linked()
        roots = Stored(self.classes.join(self.groups(linked), "cls", "left").withColumn("root", F.coalesce("root", "cls"))).table
        ids = roots.groupBy("root").agg(F.min("first_id").alias("class_id"))
        far = linked.groupBy("cls").agg(F.sum("far").alias("far"))
        per = (roots.join(ids, "root").join(far, "cls", "left")
               .select("cls", "root", "class_id", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        out = self.rows.join(per, "cls", "left")
        return out.select("row", "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                          F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest (doc_id, text hash) stays.

    Rows without words stay. Of rows equal in doc_id and text one stays. Columns are those of ``docs``.
    """
    found = Similarity(docs).table()
    keep = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("w"))
    keep = keep.select(F.col("w.row").alias("_row")).unionByName(found.where("root is null").select(F.col("row").alias("_row")).distinct())
    packed = docs.select(row_key().alias("_row"), F.expr("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").alias("_words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    one = packed.join(keep, "_row")
    first = F.row_number().over(W.partitionBy("_row").orderBy(F.lit(1)))
    return one.withColumn("_n", first).where("_n = 1 or not coalesce(_words, false)").select("_d.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Similarity(table(spark, sf_dir, "documents")).table().select("doc_id", "class_id", "n_links")
