"""Vectors as short codes: a codebook for each part of the vector, fitted by Lloyd's rounds over active entries.

Components become whole numbers, so distances and means are exact on any split of the rows. A round writes for every
vector its assigned entries and their exact distances; entry sums are added up per task and then in Spark, and the driver
sees one row for each component of the codebooks. In the next round an entry is active if it moved. A part whose own entry
stayed fixed compares the active entries only, against the distance it holds: all others were no nearer before and have
not moved. A part whose entry moved scans its codebook again. Ties go to the lower index in both cases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import table
from terrane.session import Stored

PARTS = 16
ENTRIES = 64     # 256 at most, a code is a byte
ROUNDS = 2
SCALE = 256
SALTS = 64       # ways in which the rows of a label are dealt when sums come back to them
ROWS = 4096      # vectors that are compared at a time


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64)


def cuts(size: int, parts: int) -> list[int]:
    return [k * size // parts for k in range(parts + 1)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, rows x entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        step = x[:, j, None] - entries[None, :, j]
        out += step * step
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of equals, and its distance."""
    d = squared(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def again(x: np.ndarray, code: np.ndarray, distance: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """What ``nearest`` returns, from the last codes and distances and the entries that moved since; also how many pairs were compared."""
    code, distance = code.copy(), distance.copy()
    rescan = moved[code]
    compared = int(rescan.sum()) * len(entries)
    if rescan.any():
        code[rescan], distance[rescan] = nearest(x[rescan], entries)
    active = np.flatnonzero(moved)
    fixed = np.flatnonzero(~rescan)
    if len(active) and len(fixed):
        other, d = nearest(x[fixed], entries[active])
        other = active[other]
        better = (d < distance[fixed]) | ((d == distance[fixed]) & (other < code[fixed]))
        code[fixed[better]], distance[fixed[better]] = other[better], d[better]
        compared += len(active) * len(fixed)
    return code, distance, compared


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _state(b: pa.RecordBatch, ints: np.ndarray, codes: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    n, size = ints.shape
    offsets = lambda w: pa.array(np.arange(n + 1, dtype=np.int32) * w)
    return pa.RecordBatch.from_arrays([
        b.column("vec_id"), b.column("label"), pa.ListArray.from_arrays(offsets(size), pa.array(ints.ravel())),
        pa.ListArray.from_arrays(offsets(codes.shape[1]), pa.array(codes.ravel().astype(np.int16))),
        pa.ListArray.from_arrays(offsets(codes.shape[1]), pa.array(distances.ravel()))], names=["vec_id", "label", "ints", "codes", "distances"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first in range(0, b.num_rows, ROWS):
            yield b.slice(first, ROWS)


def _first(books: list[np.ndarray], at: list[int]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(rows):
            ints = whole(_matrix(b.column("embedding"), at[-1]))
            found = [nearest(ints[:, s:e], book) for s, e, book in zip(at, at[1:], books)]
            yield _state(b, ints, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1))
    return batches


def _next(books: list[np.ndarray], moved: list[np.ndarray], at: list[int]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(rows):
            ints = _matrix(b.column("ints"), at[-1])
            codes, distances = (_matrix(b.column(c), len(books)).astype(np.int64) for c in ("codes", "distances"))
            for p, (s, e) in enumerate(zip(at, at[1:])):
                codes[:, p], distances[:, p], _ = again(ints[:, s:e], codes[:, p], distances[:, p], books[p], moved[p])
            yield _state(b, ints, codes, distances)
    return batches


def _sums(entries: int, at: list[int]):
    """Per task: for each used entry and place in its part, the number of parts assigned and their sum."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(at) - 1
        counts = np.zeros((parts, entries), np.int64)
        sums = [np.zeros((entries, e - s), np.int64) for s, e in zip(at, at[1:])]
        for b in _slices(rows):
            ints, codes = _matrix(b.column("ints"), at[-1]), _matrix(b.column("codes"), parts)
            for p, (s, e) in enumerate(zip(at, at[1:])):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], ints[:, s:e])
        for p in range(parts):
            used, places = np.flatnonzero(counts[p]), np.arange(sums[p].shape[1])
            if len(used) and len(places):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used) * len(places), p, np.int32)), pa.array(np.repeat(used, len(places)).astype(np.int32)),
                    pa.array(np.tile(places, len(used)).astype(np.int32)), pa.array(np.repeat(counts[p][used], len(places))),
                    pa.array(sums[p][used].ravel())], names=["part", "entry", "place", "n", "total"])
    return batches


def _means(state: DataFrame, books: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """Floored means of the parts assigned to each entry; entries without any stay. One row a component reaches the driver."""
    found = state.select("ints", "codes").mapInArrow(_sums(len(books[0]), at), "part int, entry int, place int, n long, total long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    new = [b.copy() for b in books]
    for r in found.collect():
        new[r.part][r.entry, r.place] = int(r.total) // r.n
    return new


def usable(vector: Column | str) -> Column:
    """Not null, and every component a finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


@dataclass
class Codes:
    """``table``: vec_id, label, code (hex), error. ``codebooks``: one array, entries x components, for each part."""

    table: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """sha256 of all components by part, entry and place."""
        text = ",".join(str(x) for book in self.codebooks for x in book.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Fit the codebooks to ``vectors`` (vec_id, embedding, label) and code every row by them.

    Rows whose vector is null or holds a null or a non-finite component are dropped. The others are returned row by
    row, repeated ids and rows too. Codebooks start from the ``entries`` rows with the smallest ids (null ids last,
    equal ids by vector); with fewer rows they are shorter. Vectors of another length than the most frequent one (the
    longest of equals) stay in the table with null code and error and fit nothing. A length that the parts do not
    divide gives parts that differ by one. An empty table gives no rows and no entries. Raises if distances between
    the vectors may not fit a 64-bit error. Other columns are not read.
    """
    spark = vectors.sparkSession
    clean = vectors.select("vec_id", "embedding", "label").where(usable("embedding"))
    kinds = dict(clean.dtypes)
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double")))
    # the most frequent length and its largest component
    common = clean.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("top"))
    common = common.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not common:
        return Codes(spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), [np.zeros((0, 0), np.int64)] * parts)
    size, top = common[0]["size"], common[0]["top"] or 0.0
    if size * (2 * (SCALE * top + 1)) ** 2 >= 2.0 ** 63:
        raise ValueError(f"components up to {top:g} are too large for 64-bit distances")
    at = cuts(size, parts)
    fitted = clean.where(F.size("embedding") == size)
    start = fitted.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    start = whole(np.array([r.embedding for r in start], np.float64).reshape(len(start), size))
    books = [start[:, s:e] for s, e in zip(at, at[1:])]

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints array<bigint>, codes array<smallint>, distances array<bigint>"
    state = Stored(fitted.mapInArrow(_first(books, at), schema))
    for _ in range(rounds):
        new = _means(state.table, books, at)
        moved = [(n != b).any(axis=1) for n, b in zip(new, books)]
        after = Stored(state.table.mapInArrow(_next(new, moved, at), schema))
        state.drop()
        state, books = after, new
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")))
    coded = state.table.select("vec_id", "label", F.array_join(digits, "").alias("code"), F.aggregate("distances", F.lit(0).cast("long"), lambda s, d: s + d).alias("error"))
    others = clean.where(F.size("embedding") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(coded.unionByName(others), books)


def with_label_error(coded: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``label_error``, the error summed over the rows of a label (null labels together); labels are salted, so none is one task."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select("label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code") + F.spark_partition_id(), F.lit(salts)).cast("int"))
    on = rows["label"].eqNullSafe(sums["label"]) & (rows["_salt"] == sums["_salt"])
    return rows.join(sums, on).select(*[rows[c] for c in coded.columns], "label_error")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes.table).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _op13_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Every round as an assignment by all distances and a floored mean."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS (
  SELECT r, vec_id, label, (i - 1) // w AS part, (i - 1) % w AS place, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS (SELECT part, r AS entry, place, x FROM cells WHERE r < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
far{k} AS (
  SELECT c.r, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d
  FROM cells c JOIN book{k} b USING (part, place) GROUP BY ALL),
near{k} AS (
  SELECT r, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS k FROM far{k}) WHERE k = 1)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS x
  FROM (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM cells JOIN near{k} USING (r, part) GROUP BY ALL)),
book{k + 1} AS (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, place))""")
    steps.append(f"""
coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


OP13_SQL = _op13_sql()
