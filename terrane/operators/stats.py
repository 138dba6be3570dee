"""Aggregations: marginal means, likelihoods, metrics, geodesics, contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from terrane.functions.seqcols import log10_or_neg_inf, subsequence
from terrane.functions.special import lgamma, normal_cdf
from terrane.operators.ranking import ranked_by_bucket
from terrane.operators.spaces import hamming_edges

LOG_2PI = 1.8378770664093453


def marginalize(nodes: DataFrame, length: int, keep: Sequence[int] | None = None, skip: Sequence[int] | None = None, seq: str = "seq") -> DataFrame:
    """Mean of every numeric column over the positions that are not kept."""
    if (keep is None) == (skip is None):
        raise ValueError("give exactly one of keep and skip")
    kept = list(keep) if keep is not None else [s for s in range(length) if s not in skip]
    numeric = [f.name for f in nodes.schema.fields if isinstance(f.dataType, NumericType)]
    return nodes.groupBy(subsequence(seq, kept).alias("seq")).agg(*[F.avg(c).alias(c) for c in numeric])


def marginalize_with_edges(nodes: DataFrame, length: int, keep: Sequence[int] | None = None, skip: Sequence[int] | None = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Marginal nodes, numbered in sequence order by ``idx``, and the single changes ``(i, j)`` between them."""
    means = marginalize(nodes, length, keep, skip, seq)
    kept = len(keep) if keep is not None else length - len(set(skip))
    numbered = ranked_by_bucket(means.drop("idx"), F.substring("seq", 1, max(1, kept // 2)), ["seq"], "idx")
    return numbered, hamming_edges(numbered, kept)


def counts_on_space(states: DataFrame, counts: DataFrame) -> DataFrame:
    """``(idx, seq, y, freq)``: zero-filled counts and their share of the total."""
    total = counts.agg(F.sum("y")).scalar()
    filled = states.join(counts.select("seq", "y"), "seq", "left")
    filled = filled.withColumn("y", F.coalesce(F.col("y").cast("double"), F.lit(0.0)))
    return filled.select("idx", "seq", "y", (F.col("y") / total).alias("freq"))


def unknown_sequences(states: DataFrame, counts: DataFrame) -> DataFrame:
    return counts.join(states.select("seq"), "seq", "left_anti")


def log_sum_exp(df: DataFrame, v: Column | str) -> Column:
    """Scalar column: stable log of the sum of exponentials over the whole table."""
    v = F.col(v) if isinstance(v, str) else v
    top = df.agg(F.max(v)).scalar()
    return (top + F.log(F.sum(F.exp(v - top))))


def softmax(df: DataFrame, v: str, out: str = "q") -> DataFrame:
    """Normalised exponentials in two passes (maximum, then sum)."""
    peak = df.agg(F.max(v)).scalar()
    norm = df.agg(F.sum(F.exp(F.col(v) - peak))).scalar()
    return df.withColumn(out, F.exp(F.col(v) - peak) / norm)


def log_likelihood(counts: DataFrame, q: str = "q", y: str = "y") -> DataFrame:
    """Multinomial log-likelihood: sum c log q + lnGamma(N + 1) - sum lnGamma(c + 1).

    lnGamma runs once per distinct count, not once per row.
    """
    data = counts.agg(F.sum(F.when(F.col(y) > 0, F.col(y) * F.log(q)).otherwise(0.0)).alias("fit"), F.sum(y).cast("double").alias("n"))
    distinct = counts.groupBy(F.col(y).cast("double").alias("c")).agg(F.count("*").alias("m"))
    constant = distinct.select((F.col("m") * lgamma(F.col("c") + 1.0)).alias("g")).agg(F.sum("g")).scalar()
    return data.select((F.col("fit") + lgamma(F.col("n") + 1.0) - constant).alias("logL"))


def evaluate(predictions: DataFrame, truth: DataFrame, label: str = "label", with_var: bool = True) -> DataFrame:
    """``(label, n, mse, r2[, loglikelihood])`` per set of predictions."""
    columns = ["seq", "y"] + (["y_var"] if with_var else [])
    both = truth.select(*columns).join(predictions.select(label, "seq", "ypred"), "seq").na.drop()
    return metrics(both, label, with_var)


def metrics(both: DataFrame, label: str = "label", with_var: bool = True) -> DataFrame:
    err = F.col("y") - F.col("ypred")
    varied = (F.count("*") > 1) & (F.min("ypred") < F.max("ypred")) & (F.min("y") < F.max("y"))
    measures = [
        F.count("*").alias("n"), F.avg(err * err).alias("mse"),
        F.when(varied, F.pow(F.corr("ypred", "y"), F.lit(2.0))).alias("r2"),
    ]
    if with_var:
        density = -0.5 * (F.lit(LOG_2PI) + F.log("y_var") + F.try_divide(err * err, F.col("y_var")))
        measures.append(F.avg(F.when(F.col("y_var") > 0, density)).alias("loglikelihood"))
    return both.groupBy(label).agg(*measures)


def loss_curve(losses: DataFrame, value: str = "beta", loss: str = "loss") -> DataFrame:
    """Mean, sd, number and standard error of a loss over folds."""
    return losses.groupBy(value).agg(
        F.avg(loss).alias("mean"), F.stddev_samp(loss).alias("sd"), F.count("*").alias("n"),
        (F.stddev_samp(loss) / F.sqrt(F.count("*"))).alias("stderr"),
    )


def best_value(losses: DataFrame, value: str = "beta", loss: str = "loss", largest: bool = False) -> DataFrame:
    curve = losses.groupBy(value).agg(F.avg(loss).alias("mean"))
    pick = F.max_by if largest else F.min_by
    return curve.agg(pick(F.col(value), F.col("mean")).alias(value), (F.max if largest else F.min)("mean").alias("mean"))


def relative_curve(losses: DataFrame, reference: float, value: str = "beta", loss: str = "loss", key: str = "fold") -> DataFrame:
    """Loss minus the loss of the same fold at a reference value."""
    base = losses.where(F.col(value) == reference).select(key, F.col(loss).alias("_base"))
    return losses.join(base, key).withColumn("rel", F.col(loss) - F.col("_base")).drop("_base")


def log_columns(losses: DataFrame, value: str = "a") -> DataFrame:
    return losses.withColumn(f"log_{value}", log10_or_neg_inf(value))


def variance_table(components: DataFrame, multiplicity: str = "m") -> DataFrame:
    """``(k, lambdas, var_perc, var_perc_cum)`` with the constant order at zero."""
    part = F.when(F.col("k") == 0, 0.0).otherwise(F.col("lambdas") * F.col(multiplicity))
    share = components.withColumn("_p", part)
    share = share.withColumn("var_perc", F.col("_p") / share.agg(F.sum("_p")).scalar())
    running = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return share.select("k", "lambdas", "var_perc", F.sum("var_perc").over(running).alias("var_perc_cum"))


def geodesic(p: DataFrame, q: DataFrame, value: str = "q") -> DataFrame:
    """2 acos(min(1, sum sqrt(p q))) between two distributions over ``idx``."""
    other = q.select("idx", F.col(value).alias("_q"))
    both = p.select("idx", value).join(other, "idx")
    return both.agg((2.0 * F.acos(F.least(F.lit(1.0), F.sum(F.sqrt(F.col(value) * F.col("_q")))))).alias("geodesic"))


def naive_contrasts(contrasts: DataFrame, obs: DataFrame) -> DataFrame:
    """Contrasts from independent measurement errors only."""
    both = contrasts.join(obs.select("seq", "y", "y_var"), "seq")
    sums = both.groupBy("name").agg(
        F.sum(F.col("weight") * F.col("y")).alias("estimate"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight") * F.col("y_var"))).alias("std"),
    )
    return with_interval(sums)


def with_interval(sums: DataFrame) -> DataFrame:
    """Two-sd interval and the larger tail probability for ``estimate`` and ``std``."""
    below = normal_cdf(-F.col("estimate") / F.col("std"))
    return sums.withColumn("ci_95_lower", F.col("estimate") - 2 * F.col("std")).withColumn(
        "ci_95_upper", F.col("estimate") + 2 * F.col("std")
    ).withColumn("p", F.greatest(below, 1.0 - below))


def stationary_mean(nodes: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return nodes.agg(F.sum(F.col(y) * F.col(p)).alias("mean_function"))


def element_sizes(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """Sizes growing with the square of a column between two bounds."""
    v2 = F.col(c) * F.col(c)
    lo, hi = df.agg(F.min(v2)).scalar(), df.agg(F.max(v2)).scalar()
    return df.withColumn("size", F.lit(float(low)) + v2 * (float(high) - float(low)) / (hi - lo))
