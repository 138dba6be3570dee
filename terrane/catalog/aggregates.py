"""Aggregations over alignments and landscapes."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.views import (
    CUSTOMER, CUSTOMER_LENGTH, EMBED, EMBED_SPACE, LINE, MSA, MSA_LENGTH, ORDER, PART, PART_SPACE, PART_VEC, customer_dna, dna_digits, embed_landscape, line_landscape,
    line_msa, normal_cdf_sql, order_dna, part_landscape, part_vector, r6, table,
)
from terrane.functions import seqcols as Q
from terrane.operators import cube as C, msa as M, ranking as R, spaces as P, stats as S
from terrane.operators.replicates import merge_replicates
from terrane.plans import kernels as K


@query(f"""WITH {CUSTOMER} SELECT a.row_id, count(*) AS n_similar, round(1.0/count(*), 9) AS weight FROM customer_dna a JOIN customer_dna b
  ON hamming(a.seq, b.seq)/{CUSTOMER_LENGTH} < 0.3 GROUP BY 1""")
def similarity_weights(spark, sf):
    """1 over the number of similar rows, from masked group counts (no pair is formed)."""
    c = customer_dna(spark, sf)
    near = M.similar_counts(c, CUSTOMER_LENGTH, 0.3)
    return c.join(near, "seq").select("row_id", "n_similar", F.round(1.0 / F.col("n_similar"), 9).alias("weight"))


@query(f"""WITH {CUSTOMER} SELECT a.row_id, count(*) AS n_similar FROM customer_dna a JOIN customer_dna b
  ON hamming(a.seq, b.seq)/{CUSTOMER_LENGTH} < 0.3 GROUP BY 1""")
def similarity_counts_in_bands(spark, sf):
    """Same counts by the banded method meant for long alignments."""
    c = customer_dna(spark, sf)
    near = M.banded_similar_counts(M.sequence_counts(c), CUSTOMER_LENGTH, M.max_mismatches(CUSTOMER_LENGTH, 0.3))
    return c.join(near, "seq").select("row_id", "n_similar")


_U = f"""{MSA}, u AS (SELECT seq, count(*) AS n FROM line_msa GROUP BY 1),
  k AS (SELECT a.seq, a.n, sum(b.n) AS near FROM u a JOIN u b ON hamming(a.seq, b.seq)/{MSA_LENGTH} < 0.3 GROUP BY 1, 2)"""


@query(f"WITH {_U} SELECT substr(seq,1,3) AS seq, round(sum(n/near), 6) AS y FROM k GROUP BY 1")
def corrected_subsequence_counts(spark, sf):
    out = M.msa_to_counts(line_msa(spark, sf), MSA_LENGTH, [0, 1, 2], correct=True, max_dist=0.3)
    return out.select("seq", r6("y").alias("y"))


@query(f"WITH {MSA} SELECT substr(seq,4,2) AS seq, CAST(sum(w) AS DOUBLE) AS y FROM line_msa GROUP BY 1")
def weighted_subsequence_counts(spark, sf):
    return M.msa_to_counts(line_msa(spark, sf), MSA_LENGTH, [3, 4], weight="w")


@query(f"WITH {MSA} SELECT seq, count(*) AS n FROM line_msa GROUP BY 1")
def sequence_counts(spark, sf):
    return M.sequence_counts(line_msa(spark, sf))


@query("SELECT l_returnflag || l_linestatus AS seq FROM lineitem")
def counts_to_sequences(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("seq"))
    return M.repeated(M.sequence_counts(li))


@query(f"""WITH {MSA}, c AS (SELECT substr(seq, CAST(s AS INT)+1, 1) AS allele, sum(w) AS w FROM line_msa, range({MSA_LENGTH}) t(s) GROUP BY 1)
  SELECT allele, round(w/sum(w) OVER (), 9) AS freq FROM c""")
def allele_frequencies(spark, sf):
    return M.allele_frequencies(line_msa(spark, sf), "w").select("allele", F.round("freq", 9).alias("freq"))


_CODE = f"""{MSA}, f AS (SELECT s AS site, substr(seq, CAST(s AS INT)+1, 1) AS allele, sum(w) AS w, min(row_id) AS o FROM line_msa, range({MSA_LENGTH}) t(s) GROUP BY 1, 2),
  code AS (SELECT site, allele, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY w DESC, o, allele) <= 3 THEN allele ELSE 'X' END AS new FROM f)"""


@query(f"WITH {_CODE} SELECT CAST(site AS BIGINT) AS site, allele, new FROM code")
def reduced_alphabet(spark, sf):
    code = M.reduced_code(line_msa(spark, sf), 3, MSA_LENGTH, "w")
    return code.withColumn("site", F.col("site").cast("bigint"))


@query(f"""WITH {_CODE}, m AS (SELECT row_id, seq, w FROM line_msa)
  SELECT a.new || b.new || c.new || d.new || e.new AS seq, CAST(sum(m.w) AS DOUBLE) AS w FROM m
  JOIN code a ON a.site = 0 AND a.allele = substr(seq,1,1) JOIN code b ON b.site = 1 AND b.allele = substr(seq,2,1)
  JOIN code c ON c.site = 2 AND c.allele = substr(seq,3,1) JOIN code d ON d.site = 3 AND d.allele = substr(seq,4,1)
  JOIN code e ON e.site = 4 AND e.allele = substr(seq,5,1) GROUP BY 1""")
def sequences_in_reduced_alphabet(spark, sf):
    rows = line_msa(spark, sf)
    maps = M.code_maps(M.reduced_code(rows, 3, MSA_LENGTH, "w"), MSA_LENGTH)
    return rows.groupBy(Q.recode("seq", maps).alias("seq")).agg(F.sum("w").alias("w"))


@query(f"""WITH {PART} SELECT substr(seq,1,1) || substr(seq,3,1) AS seq, round(avg(y), 6) AS y, round(avg(n), 6) AS n FROM part_landscape GROUP BY 1""")
def marginalized_positions(spark, sf):
    nodes = part_landscape(spark, sf).select("seq", "y", "n")
    return S.marginalize(nodes, 5, skip=[1, 3, 4]).select("seq", r6("y").alias("y"), r6("n").alias("n"))


@query(f"""WITH {PART}, m AS (SELECT substr(seq,1,1) || substr(seq,3,1) AS seq, avg(y) AS y FROM part_landscape GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS idx, seq, y FROM m)
  SELECT a.idx AS i, b.idx AS j, round(b.y - a.y, 6) AS dy FROM n a JOIN n b ON hamming(a.seq, b.seq) = 1""")
def marginalized_edges(spark, sf):
    """Single changes between marginal genotypes, with the change in the mean."""
    nodes, edges = S.marginalize_with_edges(part_landscape(spark, sf).select("seq", "y"), 5, skip=[1, 3, 4])
    end = lambda k: nodes.select(F.col("idx").alias(k), F.col("y").alias(f"y{k}"))
    return edges.join(end("i"), "i").join(end("j"), "j").select("i", "j", r6(F.col("yj") - F.col("yi")).alias("dy"))


_REPLICATES = """o AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS seq, l_tax, avg(l_extendedprice/10000.0) AS y, 1.0/count(*) AS v FROM lineitem GROUP BY 1, 2),
  merged AS (SELECT seq, sum(y/v)/sum(1/v) AS y, 1/sum(1/v) AS y_var FROM o GROUP BY 1)"""


def replicate_observations(spark, sf):
    """``(seq, y, y_var)``: one row per word and tax rate, so every word is measured several times."""
    li = table(spark, sf, "lineitem")
    seq = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    groups = li.groupBy(seq.alias("seq"), "l_tax").agg(F.avg(F.col("l_extendedprice") / 10000.0).alias("y"), (1.0 / F.count("*")).alias("y_var"))
    return groups.select("seq", "y", "y_var")


@query(f"WITH {_REPLICATES} SELECT seq, round(y, 6) AS y, round(y_var, 9) AS y_var FROM merged")
def merged_replicates(spark, sf):
    """Repeated measurements joined by inverse variance."""
    return merge_replicates(replicate_observations(spark, sf)).select("seq", r6("y").alias("y"), F.round("y_var", 9).alias("y_var"))


@query(f"""WITH {_REPLICATES}, a AS (SELECT seq, avg(y) AS y FROM o GROUP BY 1), p AS (SELECT CAST(hamming(a.seq, b.seq) AS BIGINT) AS d, a.y*b.y AS yy FROM a, a b)
  SELECT d, round(sum(yy)/count(*), 6) AS cov, count(*) AS n FROM p GROUP BY 1""")
def covariance_of_replicates(spark, sf):
    """Second moments count a word once, however often it was measured."""
    out = C.covariance_by_distance(replicate_observations(spark, sf).select("seq", "y"), 3).where("n > 0")
    return out.select("d", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


@query(f"""WITH {_REPLICATES}, a AS (SELECT seq, avg(y) AS y FROM o GROUP BY 1) SELECT round(sum((b.y-a.y)*(b.y-a.y)), 4) AS s, count(*) AS n FROM a JOIN a b ON hamming(a.seq, b.seq) = 1 AND a.seq < b.seq""")
def effects_of_replicates(spark, sf):
    """Faces are counted between words, not between measurements."""
    return C.local_epistasis(replicate_observations(spark, sf).select("seq", "y"), 3, 1).select(F.round("s", 4).alias("s"), "n")


@query(f"""WITH c AS (SELECT p_partkey % 1024 AS idx, p_size FROM part), g AS (SELECT idx, sum(p_size) AS y FROM c GROUP BY 1)
  SELECT i AS idx, CAST(coalesce(y, 0) AS DOUBLE) AS y, round(coalesce(y, 0)/(SELECT sum(y) FROM g), 9) AS freq FROM range(1024) t(i) LEFT JOIN g ON g.idx = i""")
def counts_on_whole_space(spark, sf):
    part = table(spark, sf, "part")
    counts = part.groupBy(dna_digits(F.col("p_partkey"), 5).alias("seq")).agg(F.sum("p_size").alias("y"))
    return S.counts_on_space(PART_SPACE.states(spark), counts).select("idx", "y", F.round("freq", 9).alias("freq"))


@query(f"""WITH {ORDER}, p AS (SELECT DISTINCT substr(seq, 8) AS seq FROM order_dna) SELECT seq FROM p ANTI JOIN (WITH {PART} SELECT seq FROM part_landscape WHERE y > 25) k USING (seq)""")
def sequences_outside_space(spark, sf):
    seen = order_dna(spark, sf).select(F.substr("seq", F.lit(8), F.lit(5)).alias("seq")).distinct()
    return S.unknown_sequences(part_landscape(spark, sf).where("y > 25"), seen)


_PAIRS = f"""{PART}, pairs AS (SELECT CAST(hamming(a.seq, b.seq) AS BIGINT) AS d, a.y * b.y AS yy FROM part_landscape a, part_landscape b)"""


@query(f"WITH {_PAIRS} SELECT d, round(sum(yy)/count(*), 6) AS cov, count(*) AS n FROM pairs GROUP BY 1")
def covariance_by_distance(spark, sf):
    """Second moments per Hamming distance from one cube of marginal sums."""
    out = C.covariance_by_distance(part_landscape(spark, sf), 5)
    return out.where("n > 0").select("d", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


@query(f"""WITH {EMBED}, pairs AS (SELECT CAST(hamming(a.seq, b.seq) AS BIGINT) AS d, a.y * b.y AS yy FROM embed_landscape a, embed_landscape b)
  SELECT d, round(sum(yy)/count(*), 6) AS cov, count(*) AS n FROM pairs GROUP BY 1""")
def covariance_by_distance_incomplete(spark, sf):
    return C.covariance_by_distance(embed_landscape(spark, sf), 8).where("n > 0").select("d", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


@query(f"""WITH {EMBED}, pairs AS (SELECT CAST(hamming(a.seq, b.seq) AS BIGINT) AS d, a.y * b.y AS yy FROM embed_landscape a, embed_landscape b)
  SELECT d, round(sum(yy)/count(*), 6) AS cov, count(*) AS n FROM pairs GROUP BY 1""")
def covariance_by_distance_on_space(spark, sf):
    """Same moments from order projections of the zero-filled landscape, the way for many sites."""
    from terrane.plans.regression import observed_states
    states = observed_states(EMBED_SPACE, embed_landscape(spark, sf).select("seq", "y"))
    return C.covariance_on_space(states, EMBED_SPACE).where("n > 0").select("d", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


_AGREE = " || ".join(f"CASE WHEN substr(a.seq,{s},1) = substr(b.seq,{s},1) THEN '1' ELSE '0' END" for s in range(1, 6))


@query(f"WITH {PART} SELECT {_AGREE} AS sites, round(sum(a.y*b.y)/count(*), 6) AS cov, count(*) AS n FROM part_landscape a, part_landscape b GROUP BY 1")
def covariance_by_agreeing_sites(spark, sf):
    return C.covariance_by_sites(part_landscape(spark, sf), 5).where("n > 0").select("sites", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


def _signs(length: int) -> str:
    """Sign patterns of the first components with the mean of the one that follows, in SQL."""
    letters = " || ".join(f"CASE WHEN embedding[{s + 1}] > 0 THEN 'B' ELSE 'A' END" for s in range(length))
    return f"signs AS (SELECT seq, avg(v) AS y FROM (SELECT {letters} AS seq, CAST(embedding[{length + 1}] AS DOUBLE)*10.0 AS v FROM embeddings) GROUP BY 1)"


def sign_patterns(spark, sf, length: int):
    """``(seq, y)``, a row for each embedding: far fewer patterns occur than there are."""
    seq = F.concat(*[F.when(F.col("embedding")[s] > 0, "B").otherwise("A") for s in range(length)])
    return table(spark, sf, "embeddings").select(seq.alias("seq"), (F.col("embedding")[length].cast("double") * 10.0).alias("y"))


@query(f"""WITH {_signs(20)}, pairs AS (SELECT CAST(hamming(a.seq, b.seq) AS BIGINT) AS d, a.y * b.y AS yy FROM signs a, signs b)
  SELECT d, round(sum(yy)/count(*), 6) + 0.0 AS cov, count(*) AS n FROM pairs GROUP BY 1""")
def covariance_by_distance_twenty_sites(spark, sf):
    """Second moments of an incomplete table over more sites than a cube can hold."""
    out = C.covariance_by_distance(sign_patterns(spark, sf, 20), 20).where("n > 0")
    return out.select("d", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


_AGREE_16 = " || ".join(f"CASE WHEN substr(a.seq,{s},1) = substr(b.seq,{s},1) THEN '1' ELSE '0' END" for s in range(1, 17))


@query(f"WITH {_signs(16)} SELECT {_AGREE_16} AS sites, round(sum(a.y*b.y)/count(*), 6) + 0.0 AS cov, count(*) AS n FROM signs a, signs b GROUP BY 1")
def covariance_by_agreeing_sites_sixteen(spark, sf):
    out = C.covariance_by_sites(sign_patterns(spark, sf, 16), 16)
    return out.select("sites", r6("cov").alias("cov"), F.col("n").cast("bigint").alias("n"))


_W = K.krawtchouk(PART_SPACE)
_M = K.multiplicities(PART_SPACE)
_WSQL = ", ".join(f"({k}, {d}, {float(_W[k, d])!r}, {float(_M[k])!r})" for k in range(6) for d in range(6))
_LAMBDA = f"""{PART_VEC}, s AS (SELECT CAST(hamming(a.seq, b.seq) AS INT) AS d, sum(a.v*b.v) AS yy FROM part_vec a, part_vec b GROUP BY 1),
  w(k, d, w, m) AS (VALUES {_WSQL}), vc AS (SELECT CAST(k AS BIGINT) AS k, sum(w*yy)/m AS lambdas, m FROM w JOIN s USING (d) GROUP BY k, m)"""


@query(f"WITH {_LAMBDA} SELECT k, round(lambdas, 6) AS lambdas FROM vc")
def variance_components(spark, sf):
    out = C.variance_components(part_vector(spark, sf), PART_SPACE, "v")
    return out.select(F.col("k").cast("bigint").alias("k"), r6("lambdas").alias("lambdas"))


@query(f"""WITH {_LAMBDA}, p AS (SELECT k, lambdas, CASE WHEN k = 0 THEN 0 ELSE lambdas*m END AS part FROM vc), q AS (SELECT k, part/sum(part) OVER () AS share FROM p)
  SELECT k, round(share, 6) AS var_perc, round(sum(share) OVER (ORDER BY k), 6) AS var_perc_cum FROM q""")
def variance_explained(spark, sf):
    out = S.variance_table(C.variance_components(part_vector(spark, sf), PART_SPACE, "v"))
    return out.select(F.col("k").cast("bigint").alias("k"), r6("var_perc").alias("var_perc"), r6("var_perc_cum").alias("var_perc_cum"))


def _site_set_sql(k):
    """Sum over pairs of v v' times the product of site projections, one set of sites at a time."""
    from itertools import combinations
    parts = []
    for j in combinations(range(5), k):
        factor = "*".join(f"(CASE WHEN substr(a.seq,{s + 1},1) = substr(b.seq,{s + 1},1) THEN 0.75 ELSE -0.25 END)" if s in j else "0.25" for s in range(5))
        name = "".join("1" if s in j else "0" for s in range(5))
        parts.append(f"SELECT '{name}' AS sites, round(sum(a.v*b.v*{factor})/{3.0 ** k}, 6) AS variance FROM part_vec a, part_vec b")
    return f"WITH {PART_VEC} " + " UNION ALL ".join(parts)


@query(_site_set_sql(2))
def site_pair_components(spark, sf):
    return C.site_set_components(part_vector(spark, sf), PART_SPACE, 2, "v").select("sites", r6("variance").alias("variance"))


def _faces(p, relation="part_landscape", y="y"):
    """Faces spanned by two alleles at p sites: joins of 2^p corners on their shared background."""
    if p == 1:
        return f"SELECT b.{y} - a.{y} AS v FROM {relation} a JOIN {relation} b ON hamming(a.seq, b.seq) = 1 AND a.seq < b.seq"
    terms = []
    for s in range(5):
        for t in range(s + 1, 5):
            bg = " AND ".join(f"substr({{x}}.seq,{u + 1},1) = substr(a.seq,{u + 1},1)" for u in range(5) if u not in (s, t))
            same = lambda x, site, other: f"substr({x}.seq,{site + 1},1) = substr({other}.seq,{site + 1},1)"
            terms.append(f"""SELECT d.{y} - b.{y} - c.{y} + a.{y} AS v FROM {relation} a
  JOIN {relation} b ON {bg.format(x='b')} AND {same('b', t, 'a')} AND substr(b.seq,{s + 1},1) > substr(a.seq,{s + 1},1)
  JOIN {relation} c ON {bg.format(x='c')} AND {same('c', s, 'a')} AND substr(c.seq,{t + 1},1) > substr(a.seq,{t + 1},1)
  JOIN {relation} d ON {bg.format(x='d')} AND {same('d', s, 'b')} AND {same('d', t, 'c')}""")
    return " UNION ALL ".join(terms)


@query(f"WITH {PART}, f AS ({_faces(2)}) SELECT round(sum(v*v), 4) AS s, count(*) AS n FROM f")
def pairwise_epistasis(spark, sf):
    return C.local_epistasis(part_landscape(spark, sf), 5, 2).select(F.round("s", 4).alias("s"), "n")


@query(f"WITH {PART}, f AS ({_faces(1)}) SELECT round(sum(v*v), 4) AS s, count(*) AS n FROM f")
def squared_mutation_effects(spark, sf):
    return C.local_epistasis(part_landscape(spark, sf), 5, 1).select(F.round("s", 4).alias("s"), "n")


@query(f"WITH {PART_VEC}, f AS ({_faces(2, 'part_vec', 'v')}) SELECT round(sum(v*v), 4) AS cost FROM f")
def epistasis_cost(spark, sf):
    """Sum over all faces, from the projection norms only."""
    return C.epistasis_cost(part_vector(spark, sf), PART_SPACE, 2, "v").select(F.round("cost", 4).alias("cost"))


@query(f"""WITH {LINE}, e AS (SELECT idx, y, exp(2.0*(y - max(y) OVER ())) AS e FROM line_landscape), p AS (SELECT idx, y, e/sum(e) OVER () AS p FROM e)
  SELECT round(sum(y*p), 6) AS mean_function, round(avg(y), 6) AS neutral_mean, round(quantile_cont(y, 0.8), 6) AS p80 FROM p""")
def weighted_mean_and_percentile(spark, sf):
    nodes = line_landscape(spark, sf)
    p = S.softmax(nodes.withColumn("s", F.col("y") * 2.0), "s", "p")
    mean = S.stationary_mean(p).select(r6("mean_function").alias("mean_function"))
    return mean.withColumn("neutral_mean", r6(nodes.agg(F.avg("y")).scalar())).withColumn("p80", F.round(F.lit(R.percentile(nodes, "y", 80)), 6))


@query("SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def exact_percentiles(spark, sf):
    """Order statistics of a whole column by histogram narrowing."""
    li = table(spark, sf, "lineitem")
    found = R.percentiles(li, "l_extendedprice", [10, 50, 99])
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(f"p{q}") for q, v in zip((10, 50, 99), found)])


@query("""WITH f AS (SELECT CASE WHEN l_discount = 0 THEN CAST('-inf' AS DOUBLE) WHEN l_discount >= 0.095 THEN CAST('inf' AS DOUBLE) ELSE ln(l_discount) + l_extendedprice/1e6 END AS v FROM lineitem)
  SELECT CAST('-inf' AS DOUBLE) AS p1, round(quantile_disc(v, 0.3), 6) AS p30, round(quantile_disc(v, 0.7), 6) AS p70, CAST('inf' AS DOUBLE) AS p99 FROM f
  WHERE (SELECT count(*) FROM f WHERE v = '-inf') > 0.02*(SELECT count(*) FROM f) AND (SELECT count(*) FROM f WHERE v = 'inf') > 0.02*(SELECT count(*) FROM f)""")
def percentiles_with_infinities(spark, sf):
    """Order statistics of a column with infinite values at both ends."""
    d = F.col("l_discount")
    v = F.when(d == 0, float("-inf")).when(d >= 0.095, float("inf")).otherwise(F.log(d) + F.col("l_extendedprice") / 1e6)
    rows = table(spark, sf, "lineitem").select(v.alias("v"))
    n = rows.count()
    ends = R.percentiles(rows, "v", [1, 99])
    inner = R.order_statistics(rows, "v", [ceil(0.3 * n) - 1, ceil(0.7 * n) - 1])
    return spark.range(1).select(F.lit(ends[0]).alias("p1"), F.round(F.lit(inner[0]), 6).alias("p30"), F.round(F.lit(inner[1]), 6).alias("p70"), F.lit(ends[1]).alias("p99"))


@query(f"""WITH {PART}, q AS (SELECT y/sum(y) OVER () AS q, n AS c FROM part_landscape)
  SELECT round(sum(c*ln(q)) + lgamma(CAST(sum(c) AS DOUBLE)+1) - sum(lgamma(CAST(c AS DOUBLE)+1)), 4) AS logL FROM q""")
def multinomial_log_likelihood(spark, sf):
    nodes = part_landscape(spark, sf)
    q = nodes.withColumn("q", F.col("y") / nodes.agg(F.sum("y")).scalar()).withColumn("c", F.col("n").cast("double"))
    return S.log_likelihood(q, "q", "c").select(F.round("logL", 4).alias("logL"))


@query("""WITH l AS (SELECT l_tax AS beta, l_linenumber AS fold, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2)
  SELECT beta, round(avg(loss), 9) AS mean, round(stddev_samp(loss), 9) AS sd, count(*) AS n, round(stddev_samp(loss)/sqrt(count(*)), 9) AS stderr FROM l GROUP BY 1""")
def loss_curve(spark, sf):
    losses = _losses(spark, sf)
    r9 = lambda c: F.round(c, 9).alias(c)
    return S.loss_curve(losses).select("beta", r9("mean"), r9("sd"), "n", r9("stderr"))


def _losses(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_tax").alias("beta"), F.col("l_linenumber").cast("bigint").alias("fold")).agg(F.avg("l_discount").alias("loss"))


@query("""WITH l AS (SELECT l_tax AS beta, l_linenumber AS fold, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2)
  SELECT arg_min(beta, m) AS best, round(min(m), 9) AS mean FROM (SELECT beta, avg(loss) AS m FROM l GROUP BY 1)""")
def best_hyperparameter(spark, sf):
    return S.best_value(_losses(spark, sf)).select(F.col("beta").alias("best"), F.round("mean", 9).alias("mean"))


@query("""WITH l AS (SELECT l_tax AS beta, CAST(l_linenumber AS BIGINT) AS fold, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2)
  SELECT a.beta, a.fold, round(a.loss - b.loss, 9) AS rel FROM l a JOIN l b ON a.fold = b.fold AND b.beta = 0.04""")
def relative_loss_curve(spark, sf):
    return S.relative_curve(_losses(spark, sf), 0.04).select("beta", "fold", (F.round("rel", 9) + F.lit(0.0)).alias("rel"))


@query(f"""WITH {PART}, p AS (SELECT idx, n/sum(n) OVER () AS p, exp(y/10.0)/sum(exp(y/10.0)) OVER () AS q FROM part_landscape)
  SELECT round(2*acos(least(1.0, sum(sqrt(p*q)))), 6) AS geodesic FROM p""")
def geodesic_distance(spark, sf):
    nodes = part_landscape(spark, sf)
    counts = nodes.withColumn("q", F.col("n") / nodes.agg(F.sum("n")).scalar())
    dense = S.softmax(nodes.withColumn("s", F.col("y") / 10.0), "s", "q")
    return S.geodesic(counts, dense).select(r6("geodesic").alias("geodesic"))


@query(f"""WITH {PART} SELECT idx, round(exp(y)/sum(exp(y)) OVER (), 12) AS q FROM part_landscape""")
def softmax_frequencies(spark, sf):
    return S.softmax(part_landscape(spark, sf), "y").select("idx", F.round("q", 12).alias("q"))


@query(f"""WITH {PART}, c AS (SELECT l_returnflag AS name, l_partkey % 1024 AS idx, sum(CASE WHEN l_linestatus = 'O' THEN l_discount ELSE -l_discount END) AS weight FROM lineitem GROUP BY 1, 2),
  s AS (SELECT name, sum(weight*y) AS m, sqrt(sum(weight*weight*y_var)) AS sd FROM c JOIN part_landscape USING (idx) GROUP BY 1)
  SELECT name, round(m, 4) AS estimate, round(sd, 4) AS std, round(m - 2*sd, 4) AS ci_95_lower, round(m + 2*sd, 4) AS ci_95_upper, round({normal_cdf_sql('abs(m/sd)')}, 5) AS p FROM s""")
def naive_contrasts(spark, sf):
    li = table(spark, sf, "lineitem")
    w = F.when(F.col("l_linestatus") == "O", F.col("l_discount")).otherwise(-F.col("l_discount"))
    contrasts = li.groupBy(F.col("l_returnflag").alias("name"), dna_digits(F.col("l_partkey"), 5).alias("seq")).agg(F.sum(w).alias("weight"))
    out = S.naive_contrasts(contrasts, part_landscape(spark, sf))
    r4 = lambda c: F.round(c, 4).alias(c)
    return out.select("name", r4("estimate"), r4("std"), r4("ci_95_lower"), r4("ci_95_upper"), F.round("p", 5).alias("p"))
