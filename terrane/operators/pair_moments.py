"""Second moments over all pairs of observed sequences, for more sites than the cube of marginal sums can hold.

Rows get a block by hash; each unordered pair of blocks is a unit of bounded size that one task compares, site by site for
a strip of rows against the other block, and sums by class. A unit returns its sums, never a pair. The work grows with the
square of the number of distinct sequences, whatever their length; the cube's grows with 2^l times that number.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS, STRIP_ROWS = 4096, 128
MAX_SITES = 62   # of a set of sites that is one bigint


def letters(seqs: pd.Series, length: int) -> np.ndarray:
    """Code points, one row a sequence; what is missing to ``length`` is zero."""
    text = "".join(s[:length].ljust(length, "\0") for s in seqs)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(seqs), length)


def strip_classes(left: np.ndarray, right: np.ndarray, by_sites: bool) -> np.ndarray:
    """Class of every pair: the bits of the sites that agree (site 0 highest), or the number of sites that differ."""
    out = np.zeros((len(left), len(right)), dtype=np.int64 if by_sites else np.int16)
    for s in range(left.shape[1]):
        same = left[:, s, None] == right[None, :, s]
        out = out * 2 + same if by_sites else out + ~same
    return out.ravel()


def unit_sums(x: np.ndarray, y: np.ndarray, first: np.ndarray, alone: bool, by_sites: bool) -> pd.DataFrame:
    """``(class, ss, nn)`` of a unit: sums of y y' and numbers over its ordered pairs.

    ``first`` marks the rows of the lower block; ``alone`` a block that is compared with itself.
    """
    left, right = (x, x) if alone else (x[first], x[~first])
    yl, yr = (y, y) if alone else (y[first], y[~first])
    times, found = 1 if alone else 2, []
    for at in range(0, len(left), STRIP_ROWS):
        classes = strip_classes(left[at:at + STRIP_ROWS], right, by_sites)
        names, place = np.unique(classes, return_inverse=True) if by_sites else (np.arange(x.shape[1] + 1), classes)
        products = np.outer(yl[at:at + STRIP_ROWS], yr).ravel()
        found.append(pd.DataFrame({"class": names, "ss": times * np.bincount(place, products, len(names)), "nn": times * np.bincount(place, minlength=len(names))}))
    return pd.concat(found).groupby("class", as_index=False).sum() if found else pd.DataFrame({"class": [], "ss": [], "nn": []})


def pair_sums(rows: DataFrame, length: int, by_sites: bool = False, keys: Sequence[str] = (), y: str = "y", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(keys, class, ss, nn)``: sum of y y' and number of ordered pairs of rows for each distance or set of agreeing sites.

    ``rows`` holds a sequence once for each value of the keys. A null sequence counts as an empty one, shorter ones agree where both end.
    """
    if by_sites and length > MAX_SITES:
        raise ValueError(f"sets of sites are limited to {MAX_SITES} sites")
    held = [f"_key{i}" for i in range(len(keys))]
    rows = rows.select(*[F.col(k).alias(h) for k, h in zip(keys, held)], F.coalesce("seq", F.lit("")).alias("seq"), F.col(y).cast("double").alias("y"))
    blocks = max(1, ceil(rows.count() / block_rows))
    own = rows.withColumn("b", F.pmod(F.xxhash64("seq"), F.lit(blocks)).cast("int"))
    # a row meets every block once: with its own block it stands alone, of two blocks the lower one is first
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = met.select(*held, "seq", "y", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), (F.col("b") < F.col("other")).alias("lower"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = bool(pdf["lo"].iloc[0] == pdf["hi"].iloc[0])
        out = unit_sums(letters(pdf["seq"], length), pdf["y"].to_numpy(float), pdf["lower"].to_numpy(bool), alone, by_sites)
        for h in reversed(held):
            out.insert(0, h, [pdf[h].iloc[0]] * len(out))
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in held)
    schema = ", ".join(([fields] if fields else []) + ["class bigint", "ss double", "nn bigint"])
    sums = units.groupBy(*held, "lo", "hi").applyInPandas(compare, schema)
    total = sums.groupBy(*held, "class").agg(F.sum("ss").alias("ss"), F.sum(F.col("nn").cast("decimal(19,0)")).cast("decimal(38,0)").alias("nn"))
    return total.select(*[F.col(h).alias(k) for k, h in zip(keys, held)], "class", "ss", "nn")
