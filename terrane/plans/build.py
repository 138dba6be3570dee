"""End-to-end build of a dataset: infer the landscape, embed it, save all layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.operators.msa import sequence_counts
from terrane.operators.spaces import Space, infer_space
from terrane.plans import density as D, regression as R
from terrane.plans.embedding import embed_landscape
from terrane.session import cut
from terrane.sources.datasets import DataSet


def infer_landscape(data: DataFrame, space: Space | None = None, p: int = 2, a: float | None = None, n_scales: int = 20, folds: int = 5, regularize: bool = False) -> tuple[Space, DataFrame, float | None]:
    """Density of a sample (column ``X``) or regression of values (column ``y``): (space, landscape, Ns)."""
    if "X" in data.columns:
        counts = sequence_counts(data.select(F.col("X").alias("seq"))).withColumnRenamed("n", "y")
        space = space or infer_space(counts, full=False, regular=True)
        if a is None:
            # copies of a sequence are numbered, so the folds do not depend on how the rows are stored
            copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("y")))
            rows = counts.select("seq", copies.alias("copy")).select("seq", F.lit(1.0).alias("y"), F.concat_ws(":", "seq", "copy").alias("row_id"))
            states = cut(D.density_states(space, counts))
            a = D.best_scale(D.cross_validate_density(cut(rows), space, p, D.scale_grid(states, space, p, n_scales), folds))
        fitted = D.fit_field(cut(D.density_states(space, counts)), space, D.Prior(p, a))
        table = D.density_table(fitted, space)
        return space, cut(table.select("idx", "seq", F.log("Q_star").alias("y"))), 1.0
    if "y" in data.columns:
        space = space or infer_space(data, full=False, regular=True)
        lambdas = R.fit_regularized(data, space)[0] if regularize else R.fit_variance_components(data, space)
        return space, cut(R.posterior_mean(data, space, lambdas)), None
    raise ValueError("the data need a column X or y")


def build(spark: SparkSession, root: str, name: str, data: DataFrame, k: int = 3, mode: str = "error", rtol: float = 1e-6, **options) -> DataSet:
    """Infer, embed at 80 % of the way from the mean to the maximum (Ns = 1 for densities), save."""
    space, landscape, ns = infer_landscape(data, **options)
    mean, top = landscape.agg(F.avg("y"), F.max("y")).first()
    target = None if ns is not None else mean + 0.8 * (top - mean)
    _, nodes, decay = embed_landscape(landscape, space.edges(spark), space.n, k, ns, target, rtol=rtol)
    dataset = DataSet(
        spark, root, name, data=data, landscape=landscape, nodes=nodes, edges=space.edges(spark).where("j > i"), relaxation_times=decay
    )
    dataset.save(mode)
    return dataset
