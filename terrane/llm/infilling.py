"""Fill-in-the-middle texts, cut at unit boundaries that a compressed set of integers holds.

The boundaries of a text are a set of code point offsets, 0 and the end of each unit. The set is kept in containers of
65,536 offsets, each in the smallest of three forms: sorted 16-bit values, a bitmap, or runs. A running sum of the
containers' cardinalities finds the container of the k-th boundary by binary search; a local select inside it gives the
offset. A unit is blanks and then a word, or blanks at the end of the text, so boundaries come from one comparison of
neighbouring characters. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import table, text_or_empty

SEED = 42
RATE = 50            # percent of the texts that are rearranged
SUFFIX_FIRST = 80    # percent of those with the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16       # offsets of a container
_LOW_BITS = np.arange(64, dtype=np.uint64)


class ArrayPart:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])

    @property
    def nbytes(self) -> int:
        return self.values.nbytes


class BitmapPart:
    """One bit per offset, in 64-bit words, and how many bits are set before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        set_bits = np.flatnonzero((self.words[word] >> _LOW_BITS) & np.uint64(1))
        return 64 * word + int(set_bits[k - self.before[word]])

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class RunPart:
    """First offsets of the runs and how many offsets lie in the runs before each."""

    def __init__(self, firsts: np.ndarray, lengths: np.ndarray):
        self.firsts = firsts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.firsts[run]) + k - int(self.before[run])

    @property
    def nbytes(self) -> int:
        return self.firsts.nbytes + self.before.nbytes


def container(values: np.ndarray) -> ArrayPart | BitmapPart | RunPart:
    """The smallest form for sorted offsets below SPAN."""
    heads = np.flatnonzero(np.diff(values, prepend=values[0] - 2) != 1)
    runs, array, bitmap = 6 * len(heads) + 4, 2 * len(values), SPAN // 8 + 4 * (SPAN // 64 + 1)
    if runs < min(array, bitmap):
        return RunPart(values[heads], np.diff(np.append(heads, len(values))))
    return ArrayPart(values) if array <= bitmap else BitmapPart(values)


class BoundarySet:
    """A set of offsets, given in ascending blocks; ``select(k)`` is its k-th smallest member, from 0."""

    def __init__(self, blocks: Iterator[tuple[int, np.ndarray]]):
        self.bases, self.parts, sizes = [], [], []
        for base, values in blocks:
            if len(values):
                self.bases.append(base)
                self.parts.append(container(values))
                sizes.append(len(values))
        self.before = [0, *accumulate(sizes)]

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = bisect_right(self.before, k) - 1
        return self.bases[at] + self.parts[at].select(k - self.before[at])


def _blank(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (c == 0x20) | ((c >= 0x09) & (c <= 0x0D))


def _unit_ends(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Boundaries of a text in blocks of SPAN offsets: 0, each place after a word's last character, and the end."""
    for base in range(0, len(text) + 1, SPAN):
        # offset o is a boundary if the character before it is of a word and the one at o is not
        blank = _blank(text[max(base - 1, 0):base + SPAN])
        if base == 0:
            blank = np.concatenate([[True], blank])
        if base + SPAN > len(text):
            blank = np.concatenate([blank, [True]])
        at = ~blank[:-1] & blank[1:]
        if base == 0:
            at[0] = True
        if base + SPAN > len(text):
            at[len(text) - base] = True
        yield base, np.flatnonzero(at[:SPAN])


def boundaries(text: str) -> BoundarySet:
    """0 and the ends of the units ``[blanks]*[others]+`` or, at the end of the text, ``[blanks]+``."""
    return BoundarySet(_unit_ends(text))


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k:8 * k + 8], 16) for k in range(4))


def rearranged(text: str, doc_id, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, length of prefix and middle (None if plain) and the output of one text."""
    ends = boundaries(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = (ends.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def infill(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Null and empty texts have no unit and stay plain, with an empty output; so does any text that holds a marker, as it
    is. A null id draws as the empty string. Equal rows get equal results; an empty table gives no rows. Whole texts
    are read, 65,536 characters at a time; other columns than doc_id and text are not read.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            made, size, first = [], 0, 0
            ids = b.column("doc_id")
            for k, (doc, text) in enumerate(zip(ids.to_pylist(), b.column("text"))):
                made.append(rearranged(text.as_py() or "", doc, seed, rate, suffix_first))
                size += len(made[-1][-1])
                if size > 1 << 24 or k + 1 == b.num_rows:
                    n, form, prefix, middle, output = zip(*made)
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(first, len(made)), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    made, size, first = [], 0, k + 1

    return docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; a rearranged text holds no marker, so its markers cut it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
