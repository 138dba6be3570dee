"""State tables, mutation graphs and product spaces, joined to values from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.selections import CODONS, LINE_EDGES, PART_EDGES, _AA, protein_landscape
from terrane.catalog.views import (
    LINE, LINE_SPACE, ORDER, ORDER_LENGTH, PART, PART_SPACE, PART_VEC, customer_dna, dna_digits, dna_digits_sql, line_landscape, line_msa, order_dna, part_landscape, part_vector, r6, table,
)
from terrane.operators import spaces as P


@query(f"""SELECT t.i AS idx, {dna_digits_sql('t.i', 6)} AS seq, coalesce(n, 0) AS n, CAST(coalesce(q, 0) AS DOUBLE) AS quantity
  FROM range(4096) t(i) LEFT JOIN (SELECT l_partkey % 4096 AS i, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l.i = t.i""")
def all_states(spark, sf):
    """Every sequence of a space in index order, with the line items of each."""
    space = P.Space.regular(6, "ACGT")
    li = table(spark, sf, "lineitem").select(dna_digits(F.col("l_partkey"), 6).alias("seq"), "l_quantity")
    seen = li.groupBy("seq").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    out = space.states(spark).join(seen, "seq", "left")
    return out.select("idx", "seq", F.coalesce("n", P.int64(0)).alias("n"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query(f"WITH {LINE} SELECT idx, seq, round(y, 6) AS y FROM line_landscape")
def sequence_space(spark, sf):
    """Full space inferred from the data in first-appearance order, with its values."""
    space = P.infer_space(line_landscape(spark, sf))
    _, nodes = P.sequence_space(spark, line_landscape(spark, sf), space)
    return nodes.select("idx", "seq", r6("y").alias("y"))


@query(f"""WITH {PART_EDGES} SELECT i, j, round(b.y - a.y, 6) AS dy FROM edges JOIN part_landscape a ON a.idx = i JOIN part_landscape b ON b.idx = j""")
def hamming_graph(spark, sf):
    """Edges by index arithmetic; only the far end's value needs a join."""
    nodes = part_landscape(spark, sf)
    e = PART_SPACE.expand_neighbours(nodes.select(F.col("idx").alias("i"), F.col("y").alias("yi")), "i")
    far = nodes.select(F.col("idx").alias("j"), F.col("y").alias("yj"))
    return e.join(far, "j").select("i", "j", (r6(F.col("yj") - F.col("yi"))).alias("dy"))


@query(f"""WITH {LINE_EDGES}, d AS (SELECT i, count(*) AS d FROM edges GROUP BY 1) SELECT CAST(sum(d) AS BIGINT) AS n_edges, min(d) AS min_degree, max(d) AS max_degree, min(d) = max(d) AS regular FROM d""")
def degree_statistics(spark, sf):
    return P.degree_stats(P.hamming_edges(line_landscape(spark, sf), 3))


@query(f"""WITH {LINE_EDGES} SELECT 0::BIGINT AS loops, 0::BIGINT AS asymmetric, (SELECT count(*) FROM edges JOIN line_landscape a ON a.idx = i JOIN line_landscape b ON b.idx = j WHERE a.y + b.y < 10.1) AS negative,
  (SELECT count(*) FROM line_landscape WHERE n < 1370) AS orphans, (SELECT count(*) FROM line_landscape WHERE n >= 1370 AND y_var IS NULL) AS missing_y""")
def validity_report(spark, sf):
    nodes = line_landscape(spark, sf)
    y = lambda k: nodes.select(F.col("idx").alias(k), F.col("y").alias(f"y{k}"))
    edges = P.hamming_edges(nodes, 3).join(y("i"), "i").join(y("j"), "j").select("i", "j", (F.col("yi") + F.col("yj") - 10.1).alias("w"))
    kept = nodes.where("n >= 1370").withColumn("y", F.when(F.col("y_var").isNotNull(), F.col("y")))
    return P.validity_report(kept, edges)


_COUNTS = f"""codons(c, r) AS (VALUES {CODONS}), sub AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM codons a JOIN codons b ON hamming(a.c, b.c) = 1 GROUP BY 1, 2),
  aa AS (SELECT i, substr('ACDEFGHIKLMNPQRSTVWY', CAST(i AS INT)+1, 1) AS r FROM range(20) t(i))"""


@query(f"""WITH {_COUNTS}, p AS (SELECT i, avg(p_size) AS y FROM (SELECT p_partkey % 400 AS i, p_size FROM part) GROUP BY 1)
  SELECT s.i, s.j, round(b.y - a.y, 6) AS dy FROM (
    SELECT a.i*20 + c.i AS i, b.i*20 + c.i AS j FROM aa a, aa b, aa c WHERE a.i <> b.i AND EXISTS (SELECT 1 FROM sub WHERE x = a.r AND y = b.r)
    UNION ALL SELECT c.i*20 + a.i, c.i*20 + b.i FROM aa a, aa b, aa c WHERE a.i <> b.i AND EXISTS (SELECT 1 FROM sub WHERE x = a.r AND y = b.r)) s
  JOIN p a ON a.i = s.i JOIN p b ON b.i = s.j""")
def codon_restricted_edges(spark, sf):
    """Two-residue space: substitutions one nucleotide change can make, with value differences."""
    space = P.Space.regular(2, "ACDEFGHIKLMNPQRSTVWY")
    y = table(spark, sf, "part").groupBy(F.pmod("p_partkey", P.int64(400)).alias("idx")).agg(F.avg("p_size").alias("y"))
    e = P.codon_edges(space, spark)
    e = e.join(y.select(F.col("idx").alias("i"), F.col("y").alias("yi")), "i").join(y.select(F.col("idx").alias("j"), F.col("y").alias("yj")), "j")
    return e.select("i", "j", r6(F.col("yj") - F.col("yi")).alias("dy"))


@query(f"""WITH {_COUNTS}, {_AA.split(', word AS', 1)[0].replace('codons(c, r)', 'codons2(c, r)')}, {'word AS' + _AA.split(', word AS', 1)[1]}
  SELECT a.seq AS x, b.seq AS y, n, round(b.y - a.y, 6) AS dy FROM sub JOIN protein a ON a.seq = sub.x JOIN protein b ON b.seq = sub.y""")
def codon_substitution_counts(spark, sf):
    """Number of one-nucleotide changes between residues, with the change in value."""
    counts = spark.createDataFrame([(x, y, n) for (x, y), n in P.codon_substitutions().items()], "x string, y string, n bigint")
    value = lambda k: protein_landscape(spark, sf).select(F.col("seq").alias(k), F.col("y").alias(f"y{k}"))
    both = F.broadcast(counts).join(value("x"), "x").join(value("y"), "y")  # at most 441 residue pairs
    return both.select("x", "y", "n", r6(F.col("yy") - F.col("yx")).alias("dy"))


@query(f"""WITH {PART} SELECT idx, seq, CAST(hamming(seq, 'ACGTA') AS BIGINT) AS distance, round(y, 6) AS y FROM part_landscape WHERE hamming(seq, 'ACGTA') <= 2""")
def hamming_ball(spark, sf):
    """Ball around a word grown site by site, with the values of its states."""
    ball = P.hamming_ball(spark, "ACGTA", PART_SPACE, 2)
    return ball.join(part_landscape(spark, sf).select("idx", "y"), "idx").select("idx", "seq", F.col("distance").cast("bigint").alias("distance"), r6("y").alias("y"))


BALL_LENGTH = 30


@query(f"""WITH RECURSIVE w AS (SELECT {dna_digits_sql('s_suppkey', BALL_LENGTH)} AS seq FROM supplier), c AS (SELECT repeat('A', {BALL_LENGTH}) AS centre),
  d AS (SELECT max(hamming(seq, centre)) AS d FROM w, c), cells AS (SELECT s, substr(seq, CAST(s AS INT), 1) AS a FROM w, range(1, {BALL_LENGTH + 1}) t(s) UNION SELECT s, 'A' FROM range(1, {BALL_LENGTH + 1}) t(s)),
  ball(k, seq, distance) AS (SELECT 0::BIGINT, '', 0::BIGINT UNION ALL SELECT s, seq || a, distance + CASE WHEN a <> 'A' THEN 1 ELSE 0 END FROM ball JOIN cells ON s = k + 1, d WHERE distance + CASE WHEN a <> 'A' THEN 1 ELSE 0 END <= d.d)
  SELECT seq, distance FROM ball WHERE k = {BALL_LENGTH}""")
def hamming_ball_of_sequences(spark, sf):
    """Ball of 30-letter words that reaches the farthest word of a table, from the alleles seen."""
    words = table(spark, sf, "supplier").select(dna_digits(F.col("s_suppkey"), BALL_LENGTH).alias("seq"))
    return P.hamming_ball_of(words, "A" * BALL_LENGTH).select("seq", F.col("distance").cast("bigint").alias("distance"))


@query(f"""WITH {PART}, b AS (SELECT * FROM part_landscape WHERE hamming(seq, 'ACGTA') <= 2) SELECT a.idx AS i, b.idx AS j FROM b a JOIN b ON hamming(a.seq, b.seq) = 1""")
def hamming_ball_edges(spark, sf):
    ball = P.hamming_ball(spark, "ACGTA", PART_SPACE, 2).join(part_landscape(spark, sf).select("idx"), "idx")
    return P.hamming_edges(ball, 5)


_LINKS = [[(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0)], [(0, 1, 0.5), (1, 0, 0.5)], [(a, b, 1.0) for a in range(7) for b in range(7) if abs(a - b) in (1, 6)]]
_LINK_SQL = " UNION ALL ".join(
    f"SELECT idx AS i, idx + ({b - a})*{stride} AS j, CAST({w} AS DOUBLE) AS w FROM line_landscape WHERE idx//{stride}%{radix} = {a}"
    for site, stride, radix in zip(_LINKS, (14, 7, 1), (3, 2, 7)) for a, b, w in site
)


@query(f"""WITH {LINE}, e AS ({_LINK_SQL}) SELECT e.i, e.j, e.w, round(b.y - a.y, 6) AS dy FROM e JOIN line_landscape a ON a.idx = e.i JOIN line_landscape b ON b.idx = e.j""")
def product_space_edges(spark, sf):
    """Product of a path, an edge and a ring, with the change in price along each link."""
    nodes = line_landscape(spark, sf)
    e = P.product_edges(spark, [3, 2, 7], _LINKS)
    e = e.join(nodes.select(F.col("idx").alias("i"), F.col("y").alias("yi")), "i").join(nodes.select(F.col("idx").alias("j"), F.col("y").alias("yj")), "j")
    return e.select("i", "j", "w", r6(F.col("yj") - F.col("yi")).alias("dy"))


@query("""SELECT (instr('ANR', l_returnflag)-1)*14 + (instr('FO', l_linestatus)-1)*7 + l_linenumber - 1 AS idx,
  l_returnflag || '-' || l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def product_space_states(spark, sf):
    states = P.product_states(spark, [list("ANR"), list("FO"), list("1234567")])
    label = F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    seen = table(spark, sf, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return states.join(seen, "label").select("idx", "label", "n")


@query("""WITH g AS (SELECT a.i*7 + b.i AS idx, a.i AS x0, b.i AS x1 FROM range(7) a(i), range(7) b(i)),
  l AS (SELECT (l_linenumber-1)*7 + CAST(floor((l_quantity-1)/7.2) AS BIGINT) AS idx, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT g.idx, x0 || '-' || x1 AS label, round(ln(exp(-(abs(x0-1.0)+abs(x1-5.0))/1.5) + exp(-(abs(x0-4.0)+abs(x1-2.0))/1.5)), 6) AS y, n FROM g JOIN l ON l.idx = g.idx""")
def grid_peaks(spark, sf):
    """Lattice nodes with a two-peak surface and the line items of each cell."""
    nodes, _ = P.grid_space(spark, 7, 2)
    cell = (F.col("l_linenumber") - 1) * 7 + F.floor((F.col("l_quantity") - 1) / 7.2)
    seen = table(spark, sf, "lineitem").groupBy(cell.cast("bigint").alias("idx")).agg(F.count("*").alias("n"))
    return P.peak_surface(nodes, [[1, 5], [4, 2]], 1.5).join(seen, "idx").select("idx", "label", r6("y").alias("y"), "n")


@query("""WITH l AS (SELECT (l_linenumber-1)*7 + CAST(floor((l_quantity-1)/7.2) AS BIGINT) AS idx, avg(l_extendedprice/10000.0) AS y FROM lineitem GROUP BY 1)
  SELECT a.idx AS i, b.idx AS j, round(b.y - a.y, 6) AS dy FROM l a JOIN l b ON abs(a.idx//7 - b.idx//7) + abs(a.idx%7 - b.idx%7) = 1""")
def grid_edges(spark, sf):
    _, edges = P.grid_space(spark, 7, 2)
    cell = (F.col("l_linenumber") - 1) * 7 + F.floor((F.col("l_quantity") - 1) / 7.2)
    y = table(spark, sf, "lineitem").groupBy(cell.cast("bigint").alias("idx")).agg(F.avg(F.col("l_extendedprice") / 10000.0).alias("y"))
    e = edges.join(y.select(F.col("idx").alias("i"), F.col("y").alias("yi")), "i").join(y.select(F.col("idx").alias("j"), F.col("y").alias("yj")), "j")
    return e.select("i", "j", r6(F.col("yj") - F.col("yi")).alias("dy"))
