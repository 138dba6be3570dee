"""Regression and density estimation, next to exact dense solutions in SQL where they are small."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.aggregates import _LAMBDA, _faces
from terrane.catalog.elimination import solved
from terrane.catalog.views import EMBED, EMBED_SPACE, PART, PART_SPACE, embed_landscape, normal_cdf_sql, part_landscape, part_vector, r6, table
from terrane.operators import msa as M
from terrane.operators.spaces import Space
from terrane.operators.splits import cross_validate
from terrane.plans import density as D, kernels as K, regression as R
from terrane.plans.connectedness import fit_connectedness
from terrane.session import cut

LAMBDAS = [4.0, 3.0, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01]
WORD_SPACE = Space.regular(4, "ACGT")


def observations(spark, sf):
    """Sign patterns of the embeddings with their mean value and a variance from the row count."""
    return embed_landscape(spark, sf).select("seq", "y", (0.5 / F.col("n")).alias("y_var"))


def _by_distance(cov) -> str:
    return "CASE bit_count(CAST(xor(a.i, b.i) AS BIGINT)) " + " ".join(f"WHEN {d} THEN {float(c)!r}" for d, c in enumerate(cov)) + " END"


_STATES = f"{EMBED}, st AS (SELECT t.i, e.y, 0.5/e.n AS v, e.idx IS NOT NULL AS known FROM range(256) t(i) LEFT JOIN embed_landscape e ON e.idx = t.i)"
_DELTA = K.kernel_by_distance(EMBED_SPACE, K.delta_lambdas(EMBED_SPACE, 2))
_SCALED = K.kernel_by_distance(EMBED_SPACE, 100.0 / K.n_faces(EMBED_SPACE, 2) * K.delta_lambdas(EMBED_SPACE, 2))
_COV = K.kernel_by_distance(EMBED_SPACE, LAMBDAS)


@query(f"""WITH RECURSIVE {_STATES}, sys AS (SELECT a.i, b.i AS j, CAST(CASE WHEN a.known THEN CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END ELSE {_by_distance(_DELTA)} END AS DOUBLE) AS a FROM st a, st b
    UNION ALL SELECT i, 256, coalesce(y, 0.0) FROM st), {solved(256)} SELECT idx, round(x0, 4) + 0.0 AS y FROM x""")
def interpolated_landscape(spark, sf):
    """Unobserved sign patterns filled in with the least pairwise epistasis."""
    obs = observations(spark, sf).select("seq", "y")
    return R.interpolate(obs, EMBED_SPACE, 2).select("idx", (F.round("y", 4) + F.lit(0.0)).alias("y"))


@query(f"""WITH RECURSIVE {_STATES}, sys AS (SELECT a.i, b.i AS j, {_by_distance(_SCALED)} + CASE WHEN a.i = b.i AND a.known THEN 1/a.v ELSE 0.0 END AS a FROM st a, st b
    UNION ALL SELECT i, 256, coalesce(y/v, 0.0) FROM st), {solved(256)} SELECT idx, round(x0, 4) + 0.0 AS y FROM x""")
def epistasis_regression(spark, sf):
    """Posterior mean under a pairwise-epistasis prior with known noise."""
    out = R.epistasis_regression(observations(spark, sf), EMBED_SPACE, 2, 100.0)
    return out.select("idx", (F.round("y", 4) + F.lit(0.0)).alias("y"))


@query(f"WITH {PART}, f AS ({_faces(2)}) SELECT round(1008.0*count(*)/sum(v*v), 6) AS a FROM f")
def epistasis_prior_strength(spark, sf):
    """Prior scale that matches the mean squared pairwise coefficient."""
    a = R.epistasis_scale(part_landscape(spark, sf), PART_SPACE, 2)
    return spark.range(1).select(F.round(F.lit(a), 6).alias("a"))


@query()
def cross_validated_prior_strength(spark, sf):
    """Held-out log-density of the epistasis regression at two prior scales, all folds in one solve."""
    rows = R.cross_validate_scale(observations(spark, sf), EMBED_SPACE, 2, [10.0, 1000.0], folds=5)
    return spark.createDataFrame(rows, "a double, fold int, logL double")


@query()
def density_with_baseline(spark, sf):
    """Maximum-entropy field on top of a given baseline field."""
    words = line_words(spark, sf)
    counts = M.sequence_counts(words).withColumnRenamed("n", "y")
    baseline = WORD_SPACE.states(spark).select("seq", (F.col("idx") % 7 / 7.0).alias("phi"))
    fitted = D.fit_field(cut(D.density_states(WORD_SPACE, counts, baseline)), WORD_SPACE, D.Prior(2, D.INF))
    return D.density_table(fitted, WORD_SPACE)


@query(f"WITH {_LAMBDA} SELECT k, round(lambdas, 5) AS lambdas FROM vc")
def fitted_variance_components(spark, sf):
    """Alignment of order variances to the second moments; exact on a complete landscape."""
    obs = part_vector(spark, sf).select("seq", F.col("v").alias("y"))
    lam = R.fit_variance_components(obs, PART_SPACE)
    return spark.createDataFrame([(k, round(float(v), 5)) for k, v in enumerate(lam)], "k bigint, lambdas double")


_KB = f"CASE WHEN a.known AND b.known THEN {_by_distance(_COV)} ELSE 0.0 END + CASE WHEN a.i <> b.i THEN 0.0 WHEN a.known THEN a.v ELSE 1.0 END"


@query(f"""WITH RECURSIVE {_STATES}, sys AS (SELECT a.i, b.i AS j, {_KB} AS a FROM st a, st b UNION ALL SELECT i, 256, coalesce(y, 0.0) FROM st), {solved(256)},
  z AS (SELECT idx AS i, x0 FROM x) SELECT a.i AS idx, round(sum({_by_distance(_COV)} * b.x0), 5) + 0.0 AS y FROM st a, z b GROUP BY 1""")
def posterior_mean(spark, sf):
    """Gaussian-process prediction of every sign pattern."""
    out = R.posterior_mean(observations(spark, sf), EMBED_SPACE, LAMBDAS)
    return out.select("idx", (F.round("y", 5) + F.lit(0.0)).alias("y"))


RHO = [0.2, 0.5, 0.35, 0.6, 0.1, 0.45, 0.3, 0.55]
_SITES = "(0.05 * " + " * ".join(f"CASE WHEN (CAST(xor(a.i, b.i) AS BIGINT) >> {7 - s}) & 1 = 0 THEN {1 + r!r} ELSE {1 - r!r} END" for s, r in enumerate(RHO)) + ")"
_KS = f"CASE WHEN a.known AND b.known THEN {_SITES} ELSE 0.0 END + CASE WHEN a.i <> b.i THEN 0.0 WHEN a.known THEN a.v ELSE 1.0 END"


@query(f"""WITH RECURSIVE {_STATES}, sys AS (SELECT a.i, b.i AS j, CAST({_KS} AS DOUBLE) AS a FROM st a, st b UNION ALL SELECT i, 256, coalesce(y, 0.0) FROM st), {solved(256)},
  z AS (SELECT idx AS i, x0 FROM x) SELECT a.i AS idx, round(sum({_SITES} * b.x0), 5) + 0.0 AS y FROM st a, z b GROUP BY 1""")
def posterior_mean_with_site_kernel(spark, sf):
    """Prediction under another kernel: a decay of its own at every site."""
    out = R.posterior_mean(observations(spark, sf), EMBED_SPACE, K.connectedness_kernel(EMBED_SPACE, RHO, 0.05))
    return out.select("idx", (F.round("y", 5) + F.lit(0.0)).alias("y"))


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY md5('5:' || s_suppkey)) - 1 AS r, count(*) OVER () AS n FROM supplier),
  f AS (SELECT s_acctbal/1000.0 AS y, CASE WHEN r // CAST(round(n/4.0) AS BIGINT) < 4 THEN r // CAST(round(n/4.0) AS BIGINT) END AS fold FROM r), g AS (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS value),
  m AS (SELECT k AS fold, avg(y) AS mean FROM f, range(4) t(k) WHERE fold IS DISTINCT FROM k GROUP BY 1)
  SELECT value, fold, round(avg((y - value*mean)*(y - value*mean)), 6) AS loss FROM f JOIN m USING (fold), g GROUP BY 1, 2""")
def cross_validated_callbacks(spark, sf):
    """A caller's own fit, loss and preprocessing: a shrunk mean of rescaled balances."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"))
    fit = lambda train, shrink: shrink * train.agg(F.avg("y")).first()[0]
    loss = lambda test, mean: test.agg(F.avg((F.col("y") - mean) * (F.col("y") - mean))).first()[0]
    out = cross_validate(rows, fit, loss, [0.0, 0.5, 1.0], 4, 5, "s_suppkey", process=lambda df: df.withColumn("y", F.col("y") / 1000.0))
    return out.select("value", F.col("fold").cast("bigint").alias("fold"), r6("loss").alias("loss"))


_WEIGHT = {"first": "CASE WHEN i >= 128 THEN 1.0 ELSE -1.0 END / 128", "corners": "CASE i WHEN 0 THEN -1.0 WHEN 255 THEN 1.0 ELSE 0.0 END"}


@query(f"""WITH RECURSIVE {_STATES}, w AS (SELECT i, {_WEIGHT['corners']} AS w0, {_WEIGHT['first']} AS w1 FROM st),
  gk AS (SELECT a.i, sum({_by_distance(_COV)} * b.w0) AS g0, sum({_by_distance(_COV)} * b.w1) AS g1 FROM st a, w b GROUP BY 1),
  sys AS (SELECT a.i, b.i AS j, {_KB} AS a FROM st a, st b UNION ALL SELECT i, 256, coalesce(y, 0.0) FROM st
    UNION ALL SELECT i, 257, CASE WHEN known THEN g0 ELSE 0.0 END FROM st JOIN gk USING (i) UNION ALL SELECT i, 258, CASE WHEN known THEN g1 ELSE 0.0 END FROM st JOIN gk USING (i)), {solved(256, 3)},
  s AS (SELECT sum(CASE WHEN known THEN g0*x0 ELSE 0 END) AS m0, sum(CASE WHEN known THEN g1*x0 ELSE 0 END) AS m1,
      sum(w0*g0) - sum(CASE WHEN known THEN g0*x1 ELSE 0 END) AS v0, sum(w1*g1) - sum(CASE WHEN known THEN g1*x2 ELSE 0 END) AS v1
    FROM x JOIN st ON st.i = x.idx JOIN gk ON gk.i = st.i JOIN w ON w.i = st.i),
  t AS (SELECT 'corners' AS name, m0 AS m, sqrt(v0) AS sd FROM s UNION ALL SELECT 'first', m1, sqrt(v1) FROM s)
  SELECT name, round(m, 5) AS estimate, round(sd, 5) AS std, round(m - 2*sd, 4) AS ci_95_lower, round(m + 2*sd, 4) AS ci_95_upper, round({normal_cdf_sql('abs(m/sd)')}, 5) AS p FROM t""")
def posterior_contrasts(spark, sf):
    """Estimates and errors of two linear combinations, solved together."""
    states = EMBED_SPACE.states(spark)
    first = states.select(F.lit("first").alias("name"), "seq", F.when(F.col("idx") >= 128, 1.0 / 128).otherwise(-1.0 / 128).alias("weight"))
    corners = states.where("idx IN (0, 255)").select(F.lit("corners").alias("name"), "seq", F.when(F.col("idx") == 0, -1.0).otherwise(1.0).alias("weight"))
    out = R.posterior_contrasts(observations(spark, sf), EMBED_SPACE, LAMBDAS, first.unionByName(corners))
    r = lambda c, k: F.round(c, k).alias(c)
    return out.select("name", r("estimate", 5), r("std", 5), r("ci_95_lower", 4), r("ci_95_upper", 4), r("p", 5))


_ASKED = (0, 85, 129, 255)
_UNITS = " UNION ALL ".join(f"SELECT a.i, {257 + k}, CASE WHEN a.known THEN {_by_distance(_COV)} ELSE 0.0 END FROM st a JOIN st b ON b.i = {i}" for k, i in enumerate(_ASKED))


@query(f"""WITH RECURSIVE {_STATES}, sys AS (SELECT a.i, b.i AS j, {_KB} AS a FROM st a, st b UNION ALL SELECT i, 256, coalesce(y, 0.0) FROM st UNION ALL {_UNITS}), {solved(256, 1 + len(_ASKED))},
  asked AS (SELECT a.i, {', '.join(f"max(CASE WHEN b.i = {i} THEN CASE WHEN a.known THEN {_by_distance(_COV)} ELSE 0.0 END END) AS g{k}" for k, i in enumerate(_ASKED))} FROM st a, st b GROUP BY 1),
  s AS (SELECT {', '.join(f"sum(g{k}*x0) AS m{k}, {float(_COV[0])!r} - sum(g{k}*x{k + 1}) AS v{k}" for k in range(len(_ASKED)))} FROM x JOIN asked ON asked.i = x.idx)
  {' UNION ALL '.join(f"SELECT '{''.join('AB'[i >> (7 - b) & 1] for b in range(8))}' AS seq, round(m{k}, 5) AS y, round(v{k}, 5) AS y_var, round(m{k} - 2*sqrt(v{k}), 4) AS ci_95_lower, round(m{k} + 2*sqrt(v{k}), 4) AS ci_95_upper FROM s" for k, i in enumerate(_ASKED))}""")
def posterior_variance(spark, sf):
    """Predictions with errors for several sequences."""
    asked = ["".join("AB"[i >> (7 - b) & 1] for b in range(8)) for i in _ASKED]
    out = R.posterior_variance(observations(spark, sf), EMBED_SPACE, LAMBDAS, asked)
    r = lambda c, k: F.round(c, k).alias(c)
    return out.select("seq", r("y", 5), r("y_var", 5), r("ci_95_lower", 4), r("ci_95_upper", 4))


@query()
def cross_validated_losses(spark, sf):
    """Regularisation losses per fold; one cube holds the moments of all folds."""
    rows = R.cross_validate_beta(observations(spark, sf), EMBED_SPACE, R.regularization_grid(), folds=5)
    return spark.createDataFrame(rows, "beta double, log_beta double, fold int, loss double")


@query()
def connectedness_fit(spark, sf):
    """Per-site decay of the correlation between words."""
    log_mu, rho = fit_connectedness(part_landscape(spark, sf), PART_SPACE)
    return spark.createDataFrame([(s, float(x), log_mu) for s, x in enumerate(rho)], "site int, rho double, log_mu double")


@query()
def inferred_landscape(spark, sf):
    """Variance components and posterior mean of the embedding patterns in one pipeline."""
    from terrane.plans.build import infer_landscape
    return infer_landscape(observations(spark, sf), EMBED_SPACE)[1]


# --- densities -----------------------------------------------------------------------------------

def line_words(spark, sf):
    """``(row_id, seq)``: four letters per line item from discount, tax, line number and quantity."""
    li = table(spark, sf, "lineitem")
    letter = lambda k: F.substr(F.lit("ACGT"), k.cast("int") + 1, F.lit(1))
    percent = lambda c: F.round(F.col(c) * 100)
    seq = F.concat(
        letter(F.floor(percent("l_discount") / 3)), letter(F.floor(percent("l_tax") * 4 / 9)),
        letter(F.floor((F.col("l_linenumber") - 1) / 2)), letter(F.floor((F.col("l_quantity") - 1) * 4 / 50)),
    )
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), seq.alias("seq"))


_WORDS = """words AS (SELECT CAST(round(l_discount*100) AS BIGINT)//3 AS a, CAST(round(l_tax*100) AS BIGINT)*4//9 AS b, (l_linenumber-1)//2 AS c, (CAST(l_quantity AS BIGINT)-1)*4//50 AS d FROM lineitem),
  n AS (SELECT count(*) AS n FROM words), st AS (SELECT t.i AS idx, t.i//64 AS a, t.i//16%4 AS b, t.i//4%4 AS c, t.i%4 AS d FROM range(256) t(i)),
  fa AS (SELECT a, count(*)/(SELECT n FROM n) AS f FROM words GROUP BY 1), fb AS (SELECT b, count(*)/(SELECT n FROM n) AS f FROM words GROUP BY 1),
  fc AS (SELECT c, count(*)/(SELECT n FROM n) AS f FROM words GROUP BY 1), fd AS (SELECT d, count(*)/(SELECT n FROM n) AS f FROM words GROUP BY 1),
  al AS (SELECT k, count(*)/(SELECT 4*n FROM n) AS f FROM (SELECT a AS k FROM words UNION ALL SELECT b FROM words UNION ALL SELECT c FROM words UNION ALL SELECT d FROM words) GROUP BY 1),
  q AS (SELECT idx, fa.f*fb.f*fc.f*fd.f AS q, la.f*lb.f*lc.f*ld.f AS e FROM st JOIN fa USING (a) JOIN fb USING (b) JOIN fc USING (c) JOIN fd USING (d)
    JOIN al la ON la.k = a JOIN al lb ON lb.k = b JOIN al lc ON lc.k = c JOIN al ld ON ld.k = d),
  cnt AS (SELECT a*64 + b*16 + c*4 + d AS idx, count(*) AS c FROM words GROUP BY 1)"""


def word_states(spark, sf):
    counts = M.sequence_counts(line_words(spark, sf)).withColumnRenamed("n", "y")
    return cut(D.density_states(WORD_SPACE, counts))


@query(f"""WITH {_WORDS} SELECT q.idx, round(coalesce(c, 0)/(SELECT n FROM n), 8) AS frequency, round(-ln(q), 6) AS phi, round(q, 8) AS "Q_star",
  round(q/e/(SELECT sum(q/e) FROM q), 8) AS "Q_adj" FROM q LEFT JOIN cnt USING (idx)""")
def independent_site_density(spark, sf):
    """Maximum-entropy limit without interactions: the product of the site frequencies."""
    fitted = D.fit_field(word_states(spark, sf), WORD_SPACE, D.Prior(2, D.INF))
    freqs = M.frequency_map(M.allele_frequencies(line_words(spark, sf)))
    out = D.density_table(fitted, WORD_SPACE, allele_freqs=freqs)
    r8 = lambda c: F.round(c, 8).alias(c)
    return out.select("idx", r8("frequency"), r6("phi").alias("phi"), r8("Q_star"), r8("Q_adj"))


@query(f"""WITH {_WORDS} SELECT st.idx, round(coalesce(cnt.c, 0)/(SELECT n FROM n), 8) AS "Q_star" FROM st LEFT JOIN cnt USING (idx)""")
def empirical_density(spark, sf):
    """No smoothing: the density is the observed frequency."""
    fitted = D.fit_field(word_states(spark, sf), WORD_SPACE, D.Prior(2, 0.0))
    return D.density_table(fitted, WORD_SPACE).select("idx", F.round("Q_star", 8).alias("Q_star"))


@query()
def smoothed_density(spark, sf):
    """MAP density under a pairwise-epistasis penalty (compared with a dense fit in the tests)."""
    return D.density_table(D.fit_field(word_states(spark, sf), WORD_SPACE, D.Prior(2, 500.0), rtol=1e-5), WORD_SPACE)


@query()
def density_contrasts(spark, sf):
    """Laplace errors of two differences of the log-density."""
    prior = D.Prior(2, 500.0)
    fitted = cut(D.fit_field(word_states(spark, sf), WORD_SPACE, prior, rtol=1e-5))
    contrasts = spark.createDataFrame([("ends", "AAAA", 1.0), ("ends", "TTTT", -1.0), ("one", "ACGT", 1.0), ("one", "ACGA", -1.0)], "name string, seq string, weight double")
    return D.density_contrasts(fitted, WORD_SPACE, prior, contrasts)


@query()
def cross_validated_density(spark, sf):
    """Held-out log-likelihood of two smoothing strengths, all folds fitted together."""
    rows = line_words(spark, sf).withColumn("y", F.lit(1.0))
    out = D.cross_validate_density(cut(rows), WORD_SPACE, 2, [500.0, D.INF], folds=2, rtol=1e-4)
    return spark.createDataFrame(out, "a double, fold int, logL double")
