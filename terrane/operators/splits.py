"""Cross-validation folds, training-proportion designs and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from terrane.operators.ranking import hash_rank, hash_uniform
from terrane.operators.stats import evaluate
from terrane.session import keep


def assign_folds(obs: DataFrame, k: int, seed: int = 0, key: str = "seq", max_pred: int | None = None) -> DataFrame:
    """Rows with ``fold`` (null for left-over rows that always train) and ``scored``.

    Folds are consecutive runs of round(n / k) rows in a seeded hash order; with a cap only the
    first ``max_pred`` rows of a fold are scored.
    """
    n = obs.count()
    if n < k:
        raise ValueError("fewer observations than folds")
    size = round(n / k)
    ranked = hash_rank(obs, key, seed, "_rank", n)
    fold = F.floor(F.col("_rank") / size).cast("int")
    out = ranked.withColumn("fold", F.when(fold < k, fold))
    scored = F.col("fold").isNotNull()
    if max_pred is not None:
        scored = scored & (F.col("_rank") % size < max_pred)
    return out.withColumn("scored", scored).drop("_rank")


def fold_roles(folded: DataFrame, k: int) -> DataFrame:
    """One row per (split, observation): ``split`` and its ``role`` train or test."""
    each = folded.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    is_test = F.col("fold").eqNullSafe(F.col("split"))
    each = each.withColumn("role", F.when(is_test, "test").otherwise("train"))
    return each.where((F.col("role") == "train") | F.col("scored")).drop("fold", "scored")


def training_design(ps: Sequence[float] | None = None, n_ps: int = 10, n_reps: int = 3, low: float = 0.05, high: float = 0.95) -> list[tuple[int, float, int]]:
    """(id, p, rep) rows, every proportion repeated for each replicate."""
    if ps is None:
        step = (high - low) / max(n_ps - 1, 1)
        ps = [low + i * step for i in range(n_ps)]
    return [(i * n_reps + r + 1, float(p), r) for i, p in enumerate(ps) for r in range(n_reps)]


def design_frame(spark, design: Sequence[tuple[int, float, int]]) -> DataFrame:
    return spark.createDataFrame(list(design), "id int, p double, rep int")


def training_splits(obs: DataFrame, design: Sequence[tuple[int, float, int]], seed: int = 0, max_pred: int | None = None,
                    fixed_test: bool = False, key: str = "seq", test_share: float = 0.2) -> DataFrame:
    """Rows repeated per design id with ``role`` train or test, drawn by seeded hashes.

    A fixed test set has ``max_pred`` rows, or ``test_share`` of all rows where no number is given.
    """
    if not fixed_test:
        each = obs.withColumn("d", F.explode(_literal_design(design)))
        each = each.withColumns({"id": F.col("d.id"), "p": F.col("d.p"), "rep": F.col("d.rep")}).drop("d")
        u = hash_uniform(F.concat_ws(":", F.col("id"), F.col(key)), seed)
        each = each.withColumn("role", F.when(u < F.col("p"), "train").otherwise("test"))
        return _capped(each, max_pred, seed, key)
    total = obs.count()
    if max_pred is None:
        max_pred = int(total * test_share + 0.5)
    training_n = total - min(total, max_pred)
    parts = []
    for rep in sorted({r for _, _, r in design}):
        rows = [d for d in design if d[2] == rep]
        ranked = hash_rank(obs, key, f"{seed}-{rep}", "_rank", total).withColumn("d", F.explode(_literal_design(rows)))
        ranked = ranked.withColumns({"id": F.col("d.id"), "p": F.col("d.p"), "rep": F.col("d.rep")}).drop("d")
        u = hash_uniform(F.concat_ws(":", F.col("id"), F.col(key)), seed)
        scaled = F.col("p") * F.lit(total / max(training_n, 1))
        role = F.when(F.col("_rank") < max_pred, "test").when(u < scaled, "train")
        parts.append(ranked.withColumn("role", role).where("role is not null").drop("_rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _literal_design(design):
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("p"), F.lit(r).alias("rep")) for i, p, r in design])


def _capped(each: DataFrame, max_pred: int | None, seed: int, key: str) -> DataFrame:
    if max_pred is None:
        return each
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("cap"), F.col("id"), F.col(key)))
    rank = F.row_number().over(W.partitionBy("id").orderBy("_o"))
    tests = each.where("role = 'test'").withColumn("_o", order).withColumn("_r", rank).where(F.col("_r") <= max_pred)
    return each.where("role = 'train'").unionByName(tests.drop("_o", "_r"))


def sample_rows(df: DataFrame, n: int, seed: int = 0, key: str = "seq") -> DataFrame:
    """n rows without replacement in a seeded hash order (all rows when there are fewer)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).limit(n)


def evaluate_design(predictions: DataFrame, truth: DataFrame, design: DataFrame, with_var: bool = True) -> DataFrame:
    """Scores of every split joined to its row of the design table."""
    return evaluate(predictions, truth, "label", with_var).join(design.withColumnRenamed("id", "label"), "label")


def cross_validate(obs: DataFrame, train: Callable, evaluate: Callable[..., float], values: Sequence, folds: int = 10, seed: int = 0, key: str = "seq",
                   max_pred: int | None = None, process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(value, fold, loss)`` of a caller's own fit: ``evaluate(test, train(rows, value))`` for each value and fold.

    ``process`` is applied to the training and the test rows of every split before they are used.
    """
    folded = keep(assign_folds(obs, folds, seed, key, max_pred))
    rows = []
    for fold in range(folds):
        is_test = F.col("fold").eqNullSafe(F.lit(fold))
        parts = [folded.where(~is_test), folded.where(is_test & F.col("scored"))]
        learning, test = [process(p) if process else p for p in (p.drop("fold", "scored") for p in parts)]
        rows += [(float(v), fold, float(evaluate(test, train(learning, v)))) for v in values]
    folded.unpersist()
    return obs.sparkSession.createDataFrame(rows, "value double, fold int, loss double")
