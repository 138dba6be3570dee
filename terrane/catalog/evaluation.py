"""Folds, training designs, prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.views import CUSTOMER, ORDER, PART, customer_dna, dna_digits, order_dna, part_landscape, r6, table
from terrane.operators import splits as X, stats as S


@query(f"""WITH {CUSTOMER}, r AS (SELECT row_id, row_number() OVER (ORDER BY md5('3:' || row_id)) - 1 AS r, count(*) OVER () AS n FROM customer_dna),
  f AS (SELECT row_id, CAST(floor(r / CAST(round(n/7.0) AS BIGINT)) AS BIGINT) AS fold FROM r) SELECT row_id, CASE WHEN fold < 7 THEN fold END AS fold FROM f""")
def cross_validation_folds(spark, sf):
    """Seeded folds by a distributed rank of hashes."""
    return X.assign_folds(customer_dna(spark, sf), 7, 3, "row_id").select("row_id", F.col("fold").cast("bigint").alias("fold"))


@query(f"""WITH {CUSTOMER}, r AS (SELECT row_id, row_number() OVER (ORDER BY md5('3:' || row_id)) - 1 AS r, count(*) OVER () AS n FROM customer_dna),
  f AS (SELECT row_id, CASE WHEN r // CAST(round(n/5.0) AS BIGINT) < 5 THEN r // CAST(round(n/5.0) AS BIGINT) END AS fold FROM r),
  e AS (SELECT s AS split, row_id, fold IS NOT DISTINCT FROM s AS test FROM f, range(5) t(s))
  SELECT split, CASE WHEN test THEN 'test' ELSE 'train' END AS role, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM e GROUP BY 1, 2""")
def split_roles(spark, sf):
    """Training and test rows of each fold."""
    folded = X.assign_folds(customer_dna(spark, sf), 5, 3, "row_id")
    roles = X.fold_roles(folded, 5)
    return roles.groupBy(F.col("split").cast("bigint").alias("split"), "role").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


_U = "(CAST('0x' || substr(md5('11:' || id || ':' || row_id), 1, 8) AS BIGINT) / 4294967296.0)"
_DESIGN = X.training_design(n_ps=4, n_reps=2, low=0.1, high=0.7)
_DESIGN_SQL = ", ".join(f"({i},{p!r},{r})" for i, p, r in _DESIGN)


@query(f"""WITH {CUSTOMER}, d(id, p, rep) AS (VALUES {_DESIGN_SQL}) SELECT CAST(id AS BIGINT) AS id, CAST(rep AS BIGINT) AS rep, CASE WHEN {_U} < p THEN 'train' ELSE 'test' END AS role,
  count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM customer_dna, d GROUP BY 1, 2, 3""")
def training_proportion_splits(spark, sf):
    out = X.training_splits(customer_dna(spark, sf), _DESIGN, 11, key="row_id")
    return out.groupBy(F.col("id").cast("bigint").alias("id"), F.col("rep").cast("bigint").alias("rep"), "role").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"""WITH {CUSTOMER}, d(id, p, rep) AS (VALUES {_DESIGN_SQL}), r AS (SELECT c.row_id, rep, row_number() OVER (PARTITION BY rep ORDER BY md5('11-' || rep || ':' || c.row_id)) - 1 AS r, count(*) OVER (PARTITION BY rep) AS n
    FROM customer_dna c, (SELECT DISTINCT rep FROM d)),
  x AS (SELECT d.id, d.rep, row_id, CASE WHEN r < floor(n*0.2 + 0.5) THEN 'test' WHEN {_U.replace('id ||', 'd.id ||')} < d.p * n/(n - floor(n*0.2 + 0.5)) THEN 'train' END AS role FROM r JOIN d USING (rep))
  SELECT CAST(id AS BIGINT) AS id, role, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM x WHERE role IS NOT NULL GROUP BY 1, 2""")
def fixed_test_splits(spark, sf):
    """One test set per replicate, proportions rescaled to the remaining rows."""
    out = X.training_splits(customer_dna(spark, sf), _DESIGN, 11, fixed_test=True, key="row_id")
    return out.groupBy(F.col("id").cast("bigint").alias("id"), "role").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


_PRED = """pred AS (SELECT l_returnflag AS label, l_partkey % 1024 AS idx, avg(l_quantity) AS ypred FROM lineitem GROUP BY 1, 2)"""
_SCORES = f"""{PART}, {_PRED}, b AS (SELECT label, y, y_var + 1.0 AS y_var, ypred FROM pred JOIN part_landscape USING (idx) WHERE y_var IS NOT NULL),
  s AS (SELECT label, count(*) AS n, avg((y-ypred)*(y-ypred)) AS mse, pow(corr(ypred, y), 2) AS r2, avg(-0.5*(ln(2*pi()) + ln(y_var) + (y-ypred)*(y-ypred)/y_var)) AS loglikelihood FROM b GROUP BY 1)"""


def predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("label"), dna_digits(F.col("l_partkey"), 5).alias("seq")).agg(F.avg("l_quantity").alias("ypred"))


def truth(spark, sf):
    return part_landscape(spark, sf).select("seq", "y", (F.col("y_var") + 1.0).alias("y_var"))


@query(f"WITH {_SCORES} SELECT label, n, round(mse, 6) AS mse, round(r2, 9) AS r2, round(loglikelihood, 6) AS loglikelihood FROM s")
def prediction_metrics(spark, sf):
    out = S.evaluate(predictions(spark, sf), truth(spark, sf))
    return out.select("label", "n", r6("mse").alias("mse"), F.round("r2", 9).alias("r2"), r6("loglikelihood").alias("loglikelihood"))


@query(f"""WITH {_SCORES}, d AS (SELECT l_returnflag AS label, avg(l_discount) AS p, max(l_linenumber) AS rep FROM lineitem GROUP BY 1)
  SELECT label, round(p, 6) AS p, CAST(rep AS BIGINT) AS rep, n, round(mse, 6) AS mse FROM s JOIN d USING (label)""")
def evaluated_design(spark, sf):
    design = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("id")).agg(F.avg("l_discount").alias("p"), F.max("l_linenumber").cast("bigint").alias("rep"))
    out = X.evaluate_design(predictions(spark, sf), truth(spark, sf), design)
    return out.select("label", r6("p").alias("p"), "rep", "n", r6("mse").alias("mse"))
