"""Linear maps on the part landscape, next to their definition as sums over pairs of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.views import LINE, LINE_SPACE, ORDER, PART, PART_SPACE, PART_VEC, dna_digits, line_landscape, order_dna, part_landscape, part_vector, r6, table
from terrane.operators.spaces import int64
from terrane.plans import kernels as K


def by_distance_sql(lambdas) -> str:
    """Every state's sum over all states, weighted by the kernel at their distance."""
    cov = K.kernel_by_distance(PART_SPACE, lambdas)
    case = " ".join(f"WHEN {d} THEN {float(c)!r}" for d, c in enumerate(cov))
    return f"""WITH {PART_VEC} SELECT a.idx, round(sum(b.v * CASE hamming(a.seq, b.seq) {case} END), 6) AS u
  FROM part_vec a, part_vec b GROUP BY 1"""


def site_product_sql(factors) -> str:
    """Same, for a product over sites of (match, mismatch) factors."""
    parts = "*".join(f"CASE WHEN substr(a.seq,{s + 1},1) = substr(b.seq,{s + 1},1) THEN {float(m)!r} ELSE {float(x)!r} END" for s, (m, x) in enumerate(factors))
    return f"WITH {PART_VEC} SELECT a.idx, round(sum(b.v * {parts}), 6) AS u FROM part_vec a, part_vec b GROUP BY 1"


def result(df):
    return df.select("idx", r6("u").alias("u"))


LAMBDAS = [2.0, 1.0, 0.5, 0.25, 0.125, 0.0625]
RHO = [0.217, 0.431, 0.523, 0.737, 0.911]


@query(by_distance_sql(K.laplacian_lambdas(PART_SPACE)))
def laplacian(spark, sf):
    return result(K.laplacian(part_vector(spark, sf), PART_SPACE))


@query(f"""WITH {LINE} SELECT a.idx, round(sum(CASE hamming(a.seq, b.seq) WHEN 0 THEN 9.0*a.y WHEN 1 THEN -b.y ELSE 0.0 END), 6) AS u FROM line_landscape a, line_landscape b GROUP BY 1""")
def laplacian_irregular(spark, sf):
    return result(K.laplacian(line_landscape(spark, sf).withColumn("v", F.col("y")), LINE_SPACE))


@query(by_distance_sql(K.delta_lambdas(PART_SPACE, 2)))
def epistasis_operator(spark, sf):
    return result(K.delta_p(part_vector(spark, sf), PART_SPACE, 2))


@query(by_distance_sql(LAMBDAS))
def variance_component_kernel(spark, sf):
    return result(K.apply_kernel(part_vector(spark, sf), PART_SPACE, LAMBDAS))


@query(by_distance_sql([0, 0, 1, 0, 0, 0]))
def second_order_projection(spark, sf):
    return result(K.apply_kernel(part_vector(spark, sf), PART_SPACE, [0, 0, 1, 0, 0, 0]))


@query(by_distance_sql([x ** -0.5 for x in LAMBDAS]))
def kernel_inverse_root(spark, sf):
    """Functions of a kernel only change its eigenvalues."""
    return result(K.apply_kernel(part_vector(spark, sf), PART_SPACE, [x ** -0.5 for x in LAMBDAS]))


@query(site_product_sql([(0.75, -0.25) if s in (1, 3) else (0.25, 0.25) for s in range(5)]))
def site_set_projection(spark, sf):
    return result(K.project_site_set(part_vector(spark, sf), PART_SPACE, (1, 3)))


@query(site_product_sql([((1 + 3 * r) / 4, (1 - r) / 4) for r in RHO]))
def connectedness_kernel(spark, sf):
    return result(K.apply_connectedness(part_vector(spark, sf), PART_SPACE, RHO))


_GENERAL = [[[1.0 if a == b else 0.1 * (s + 1) for b in range(4)] for a in range(4)] for s in range(5)]


@query(site_product_sql([(1.0, 0.1 * (s + 1)) for s in range(5)]))
def site_matrix_product(spark, sf):
    return result(K.apply_site_matrices(part_vector(spark, sf), PART_SPACE, _GENERAL))


@query(f"WITH {PART_VEC} SELECT a.idx, round(sum(CASE WHEN hamming(a.seq, b.seq) = 2 THEN b.v ELSE 0.0 END), 6) AS u FROM part_vec a, part_vec b GROUP BY 1")
def distance_two_sum(spark, sf):
    return result(K.distance_neighbour_sum(part_vector(spark, sf), PART_SPACE, 2))


@query(site_product_sql([(0, 1) if s in (0, 2) else (1, 0) for s in range(5)]))
def site_set_sum(spark, sf):
    return result(K.site_set_neighbour_sum(part_vector(spark, sf), PART_SPACE, (0, 2)))


_COV = K.kernel_by_distance(PART_SPACE, LAMBDAS)
_ASKED = ["AAAAA", "ACGTA", "TTTTT"]
_ASKED_SQL = "(SELECT unnest(['AAAAA', 'ACGTA', 'TTTTT']) AS seq2)"


@query(f"""WITH {ORDER}, o AS (SELECT row_id, substr(seq, 8) AS seq1 FROM order_dna) SELECT row_id, seq2,
  round(CASE hamming(seq1, seq2) {' '.join(f'WHEN {d} THEN {float(c)!r}' for d, c in enumerate(_COV))} END, 9) AS k FROM o, {_ASKED_SQL}""")
def kernel_block(spark, sf):
    """Kernel between the last five letters of every order and three requested words."""
    rows = order_dna(spark, sf).select("row_id", F.substr("seq", F.lit(8), F.lit(5)).alias("seq"))
    rows = rows.withColumn("seq1", F.col("seq"))
    return _with_id(rows, lambda r: K.kernel_block(r, _ASKED, _COV, 5))


def _with_id(rows, make):
    """Kernel values per distinct word, joined back to the rows that hold it."""
    block = make(rows.select("seq").distinct())
    return rows.join(block, "seq1").select("row_id", "seq2", F.round("k", 9).alias("k"))


_CONN = "*".join(f"CASE WHEN substr(seq1,{s + 1},1) = substr(seq2,{s + 1},1) THEN {1 + 3 * r!r}::DOUBLE ELSE {1 - r!r}::DOUBLE END" for s, r in enumerate(RHO))


@query(f"""WITH {ORDER}, o AS (SELECT row_id, substr(seq, 8) AS seq1 FROM order_dna) SELECT row_id, seq2, round({_CONN}/1024.0, 9) AS k FROM o, {_ASKED_SQL}""")
def connectedness_block(spark, sf):
    rows = order_dna(spark, sf).select("row_id", F.substr("seq", F.lit(8), F.lit(5)).alias("seq")).withColumn("seq1", F.col("seq"))
    return _with_id(rows, lambda r: K.connectedness_block(r, _ASKED, PART_SPACE, RHO))


_SUB = "SELECT DISTINCT l_suppkey*7 % 1024 AS idx FROM lineitem"


@query(f"WITH {PART_VEC}, s AS ({_SUB}) SELECT p.idx, round(CASE WHEN s.idx IS NULL THEN 0.0 ELSE v END, 6) AS u FROM part_vec p LEFT JOIN s ON s.idx = p.idx")
def restrict_and_scatter(spark, sf):
    subset = table(spark, sf, "lineitem").select(F.pmod(F.col("l_suppkey") * 7, int64(1024)).alias("idx")).distinct()
    part = K.restrict(part_vector(spark, sf), subset)
    return K.scatter(PART_SPACE, part).select("idx", r6("v").alias("u"))


@query(f"WITH {PART_VEC} SELECT p.idx, round(v * sqrt(n), 6) AS u FROM part_vec p JOIN part_landscape USING (idx)")
def diagonal_scaling(spark, sf):
    d = part_landscape(spark, sf).select("idx", F.sqrt("n").alias("d"))
    return K.scale_rows(part_vector(spark, sf), d).select("idx", r6("v").alias("u"))


@query(by_distance_sql(K.exponential_lambdas(PART_SPACE, -0.05, 6)))
def truncated_exponential(spark, sf):
    """Heat-kernel smoothing: a truncated exponential series of the Laplacian."""
    return result(K.apply_kernel(part_vector(spark, sf), PART_SPACE, K.exponential_lambdas(PART_SPACE, -0.05, 6)))


@query(by_distance_sql([1, 1, 0, 0, 0, 0]))
def low_order_basis_round_trip(spark, sf):
    """Coefficients on the orders below two, and the vector they describe."""
    from terrane.session import small_rows
    vec = part_vector(spark, sf)
    b = {r.feature: r.b for r in small_rows(K.to_basis(vec, PART_SPACE, 2), 16, "basis coefficients")}
    return result(K.from_basis(PART_SPACE, 2, b, vec.select("idx"), "u"))


@query(f"WITH {PART_VEC} SELECT 'b_' AS feature, round(sum(v)/32.0, 6) AS b FROM part_vec")
def constant_basis_coefficient(spark, sf):
    return K.to_basis(part_vector(spark, sf), PART_SPACE, 1).select("feature", r6("b").alias("b"))


@query(by_distance_sql(K.extended_delta_lambdas(PART_SPACE, 2, [4.0, 2.0])))
def proper_epistasis_operator(spark, sf):
    return result(K.apply_kernel(part_vector(spark, sf), PART_SPACE, K.extended_delta_lambdas(PART_SPACE, 2, [4.0, 2.0])))


@query(f"""WITH {PART_VEC}, q AS (SELECT sum(a.v*b.v*CASE hamming(a.seq, b.seq) {' '.join(f'WHEN {d} THEN {float(c)!r}' for d, c in enumerate(_COV))} END) AS quad FROM part_vec a, part_vec b),
  n AS (SELECT sum(v*v) AS norm2 FROM part_vec) SELECT round(quad, 4) AS quad, round(norm2, 4) AS norm2, round(quad/norm2, 9) AS rayleigh FROM q, n""")
def rayleigh_quotient(spark, sf):
    out = K.quadratic_form(part_vector(spark, sf), PART_SPACE, LAMBDAS)
    return out.select(F.round("quad", 4).alias("quad"), F.round("norm2", 4).alias("norm2"), F.round("rayleigh", 9).alias("rayleigh"))


@query(f"WITH {PART_VEC} SELECT round(sum(v*n), 4) AS dot FROM part_vec JOIN part_landscape USING (idx)")
def inner_product(spark, sf):
    n = part_landscape(spark, sf).select("idx", F.col("n").cast("double").alias("v"))
    return K.inner_product(part_vector(spark, sf), n).select(F.round("dot", 4).alias("dot"))
