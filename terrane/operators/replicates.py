"""Repeated measurements of one sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def merge_replicates(obs: DataFrame, keys: Sequence[str] = ("seq",), y: str = "y", var: str = "y_var") -> DataFrame:
    """One row per sequence: ``keys``, ``y`` and, where there is one, ``y_var``.

    Replicates are joined by inverse variance. Exact ones (variance 0) leave the others out, and without
    variances the mean is taken. A single measurement is passed on as it is.
    """
    n, v = F.count(F.lit(1)), F.col(y).cast("double")
    if var not in obs.columns:
        return obs.groupBy(*keys).agg(F.when(n == 1, F.min(v)).otherwise(F.avg(v)).alias(y))
    s = F.col(var).cast("double")
    weight = F.sum(F.when(s > 0, 1.0 / s))
    merged = obs.groupBy(*keys).agg(
        n.alias("_n"), F.min(v).alias("_y"), F.min(s).alias("_s"), weight.alias("_w"),
        F.sum(F.when(s > 0, v / s)).alias("_wy"), F.avg(F.when(s == 0, v)).alias("_exact"),
    )
    single = F.col("_n") == 1
    value = F.when(single, F.col("_y")).otherwise(F.coalesce("_exact", F.col("_wy") / F.col("_w")))
    left = F.when(single, F.col("_s")).when(F.col("_exact").isNotNull(), F.lit(0.0)).otherwise(1.0 / F.col("_w"))
    return merged.select(*keys, value.alias(y), left.alias(var))
