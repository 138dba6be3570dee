"""Selections, joins, sorts and set operations over landscapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.views import (
    CUSTOMER, CUSTOMER_LENGTH, EMBED, LINE, LINE_SPACE, ORDER, ORDER_LENGTH, PART, PART_SPACE, customer_dna, dna_digits, dna_digits_sql, embed_landscape,
    line_landscape, order_dna, part_landscape, r6, table,
)
from terrane.constants import codon_table
from terrane.operators import select as S, spaces as P
from terrane.sources import tables as T

CODONS = ", ".join(f"('{c}','{r}')" for c, r in codon_table().items())
PART_EDGES = PART + """, edges AS (SELECT a.idx AS i, b.idx AS j FROM part_landscape a JOIN part_landscape b ON hamming(a.seq, b.seq) = 1)"""
LINE_EDGES = LINE + """, edges AS (SELECT a.idx AS i, b.idx AS j FROM line_landscape a JOIN line_landscape b ON hamming(a.seq, b.seq) = 1)"""


@query(f"""WITH {PART_EDGES}, c AS (SELECT a.idx, a.seq, a.y, CAST(sum(CASE WHEN a.y > b.y THEN 1 ELSE 0 END) AS BIGINT) AS n_lower
    FROM edges e JOIN part_landscape a ON a.idx = e.i JOIN part_landscape b ON b.idx = e.j GROUP BY 1, 2, 3)
  SELECT idx, seq, round(y, 6) AS y, n_lower FROM c WHERE n_lower = (SELECT max(n_lower) FROM c)""")
def local_optima(spark, sf):
    """States whose number of strictly lower neighbours is the largest found, without building edges."""
    out = P.sequence_local_optima(part_landscape(spark, sf), PART_SPACE)
    return out.select("idx", "seq", r6("y").alias("y"), "n_lower")


@query(f"""WITH {LINE_EDGES}, c AS (SELECT a.idx, a.seq, CAST(sum(CASE WHEN a.y > b.y THEN 1 ELSE 0 END) AS BIGINT) AS n_lower
    FROM edges e JOIN line_landscape a ON a.idx = e.i JOIN line_landscape b ON b.idx = e.j GROUP BY 1, 2)
  SELECT idx, seq, n_lower FROM c WHERE n_lower = (SELECT max(n_lower) FROM c)""")
def local_optima_on_edges(spark, sf):
    """Same selection over an explicit edge table (irregular space)."""
    nodes = line_landscape(spark, sf)
    return P.local_optima(nodes, P.hamming_edges(nodes, 3)).select("idx", "seq", "n_lower")


@query(f"WITH {PART} SELECT seq FROM part_landscape WHERE y < 30 AND n < 25 AND y > 20 AND n > 1")
def genotypes_in_region(spark, sf):
    return S.region(part_landscape(spark, sf), {"y": 30, "n": 25}, {"y": 20, "n": 1}).select("seq")


@query(f"WITH {PART}, l AS (SELECT DISTINCT l_suppkey % 1024 AS idx FROM lineitem) SELECT p.idx, p.seq, round(p.y, 6) AS y FROM part_landscape p SEMI JOIN l ON l.idx = p.idx")
def select_genotypes(spark, sf):
    chosen = table(spark, sf, "lineitem").select(F.pmod("l_suppkey", P.int64(1024)).alias("idx")).distinct()
    return S.genotypes(part_landscape(spark, sf), chosen, "idx").select("idx", "seq", r6("y").alias("y"))


@query(f"""WITH {PART_EDGES}, sel AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new FROM part_landscape WHERE y > 25)
  SELECT a.new AS i, b.new AS j, e.i * 1024 + e.j AS edge FROM edges e JOIN sel a ON a.idx = e.i JOIN sel b ON b.idx = e.j""")
def induced_edges(spark, sf):
    nodes = part_landscape(spark, sf)
    edges = P.hamming_edges(nodes, 5).withColumn("edge", F.col("i") * 1024 + F.col("j"))
    return S.induced_edges(edges, nodes.where("y > 25"), n=PART_SPACE.n)


_PATHS = f"""paths AS (SELECT o_orderkey AS path, s AS pos, substr({dna_digits_sql('o_orderkey', 5)}, 1, CAST(s AS INT)) || substr('AAAAA', CAST(s AS INT) + 1) AS seq
    FROM orders, range(6) t(s))"""


def mutational_paths(spark, sf):
    """``(path, pos, seq)``: from AAAAA to the word of every order key, one site after another."""
    pos = F.explode(F.sequence(P.int64(0), P.int64(5))).alias("pos")
    steps = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), dna_digits(F.col("o_orderkey"), 5).alias("w"), pos)
    reached = F.concat(F.substr("w", F.lit(1), F.col("pos").cast("int")), F.substr(F.lit("AAAAA"), F.col("pos").cast("int") + 1, F.lit(5)))
    return steps.select("path", "pos", reached.alias("seq"))


@query(f"WITH {_PATHS} SELECT path, pos AS i, pos + 1 AS j FROM paths WHERE pos < 5")
def path_step_edges(spark, sf):
    """Consecutive steps of every order's mutational path."""
    return S.path_edges(mutational_paths(spark, sf))


@query(f"""WITH {PART}, {_PATHS} SELECT path, pos, seq, round(y, 6) AS y FROM paths JOIN part_landscape USING (seq)""")
def path_nodes(spark, sf):
    steps = mutational_paths(spark, sf)
    return steps.join(part_landscape(spark, sf), "seq").select("path", "pos", "seq", r6("y").alias("y"))


@query(f"""WITH {CUSTOMER}, f AS (SELECT {'||'.join(f"substr('ACGT', CAST((s_suppkey*7)//{4 ** (7 - s)}%4 AS INT)+1, 1)" for s in range(8))} AS seq FROM supplier)
  SELECT row_id, seq FROM customer_dna c WHERE EXISTS (SELECT 1 FROM f WHERE hamming(f.seq, c.seq) <= 2)""")
def genotypes_within_distance(spark, sf):
    """Customers at most two changes from any supplier word, by masked-key semi-join."""
    focal = table(spark, sf, "supplier").select(dna_digits(F.col("s_suppkey") * 7, CUSTOMER_LENGTH).alias("seq"))
    return S.within_distance(customer_dna(spark, sf), focal, 2, CUSTOMER_LENGTH).select("row_id", "seq")


@query(f"WITH {ORDER} SELECT row_id, seq FROM order_dna WHERE regexp_matches(seq, 'GA.?[CT]A')")
def regex_selection(spark, sf):
    return S.matching(order_dna(spark, sf), "GA.?[CT]A").select("row_id", "seq")


@query(f"WITH {ORDER} SELECT row_id, seq FROM order_dna WHERE regexp_matches(seq, '^[ACGT][ACGT][AG][CT][ACGT][ACG][AGT][ACGT][GT][AC][ACGT][ACGT]$')")
def ambiguous_selection(spark, sf):
    return S.matching_ambiguous(order_dna(spark, sf), "NNRYNVDNKMNN", "dna").select("row_id", "seq")


@query("""WITH n AS (SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[2] AS DOUBLE) AS a2 FROM embeddings), f AS (SELECT * FROM n WHERE idx = 0)
  SELECT n.idx, round((n.a1-f.a1)*(n.a1-f.a1) + (n.a2-f.a2)*(n.a2-f.a2), 9) AS d2 FROM n, f ORDER BY (n.a1-f.a1)*(n.a1-f.a1) + (n.a2-f.a2)*(n.a2-f.a2), n.idx LIMIT 10""")
def closest_genotypes(spark, sf):
    e = table(spark, sf, "embeddings")
    nodes = e.select(F.col("vec_id").alias("idx"), F.concat(F.lit("v"), "vec_id").alias("seq"), F.col("embedding")[0].cast("double").alias("1"), F.col("embedding")[1].cast("double").alias("2"))
    return S.closest(nodes, "v0", 10).select("idx", F.round("d2", 9).alias("d2"))


@query(f"""WITH {ORDER} SELECT row_id, CASE WHEN regexp_matches(seq, '^[ACGT]{{6}}[CT][AG]') THEN 'NNNNNNYRNNNN' ELSE 'NNNNNNGNNNNN' END AS grp
  FROM order_dna WHERE regexp_matches(seq, '^[ACGT]{{6}}[CT][AG]') OR substr(seq,7,1) = 'G'""")
def highlighted_groups(spark, sf):
    out = S.highlight(order_dna(spark, sf), ["NNNNNNGNNNNN", "NNNNNNYRNNNN"])
    return out.select("row_id", F.col("group").alias("grp"))


@query(f"""WITH {ORDER}, codons(c, r) AS (VALUES {CODONS}), p AS (SELECT o.row_id, a.r AS r1, b.r AS r2 FROM order_dna o
    JOIN codons a ON a.c = substr(seq,1,3) JOIN codons b ON b.c = substr(seq,4,3) JOIN codons x ON x.c = substr(seq,7,3) JOIN codons z ON z.c = substr(seq,10,3)
    WHERE '*' NOT IN (x.r, z.r) AND '*' NOT IN (a.r, b.r))
  SELECT row_id, CASE WHEN r2 = 'L' THEN 'XLXX' ELSE 'SXXX' END AS grp FROM p WHERE r2 = 'L' OR r1 = 'S'""")
def highlighted_protein_groups(spark, sf):
    out = S.highlight(order_dna(spark, sf), ["SXXX", "XLXX"], protein=True)
    return out.select("row_id", F.col("group").alias("grp"))


@query(f"""WITH {PART} SELECT idx, round(y, 6) AS y FROM part_landscape WHERE y > 10 AND y < 40""")
def value_thresholds(spark, sf):
    return S.value_filter(part_landscape(spark, sf), "y", minimum=10, maximum=40).select("idx", r6("y").alias("y"))


@query(f"""WITH {PART} SELECT idx, round(y, 6) AS y FROM part_landscape ORDER BY y DESC, idx LIMIT 25""")
def top_genotypes(spark, sf):
    return S.value_filter(part_landscape(spark, sf), "y", top=25).select("idx", r6("y").alias("y"))


@query(f"""WITH {PART} SELECT idx, round(y, 6) AS y FROM part_landscape ORDER BY y, idx LIMIT 25""")
def bottom_genotypes(spark, sf):
    return S.value_filter(part_landscape(spark, sf), "y", bottom=25).select("idx", r6("y").alias("y"))


@query(f"""WITH {PART} SELECT idx, round(y, 6) AS y FROM part_landscape WHERE y > (SELECT min(y) FROM (SELECT y FROM part_landscape ORDER BY y DESC LIMIT 25))""")
def top_genotypes_strictly_above(spark, sf):
    return S.value_filter(part_landscape(spark, sf), "y", top=25, strict=True).select("idx", r6("y").alias("y"))


@query(f"WITH {PART} SELECT idx, n FROM part_landscape WHERE n >= 2 AND y_var IS NOT NULL")
def count_floor(spark, sf):
    return S.count_floor(part_landscape(spark, sf), "n", 2).select("idx", "n")


@query(f"""WITH {ORDER} SELECT row_id, CAST(s AS BIGINT) AS shift FROM order_dna, range({ORDER_LENGTH - 4 + 1}) t(s) WHERE substr(seq, CAST(s AS INT)+1, 4) IN ('ACGA', 'ACGG')""")
def shifted_motif_hits(spark, sf):
    return S.shifted_motif(order_dna(spark, sf), "ACGR", ORDER_LENGTH).select("row_id", F.col("shift").cast("bigint").alias("shift"))


def _between(lo, hi, extra=""):
    return f"""WITH {PART_EDGES}, d AS (SELECT idx, y, hamming(seq, 'AAAAA') AS ds, hamming(seq, 'CGCGC') AS de FROM part_landscape)
  SELECT e.i, e.j FROM edges e JOIN d a ON a.idx = e.i JOIN d b ON b.idx = e.j WHERE {lo} AND {hi} {extra}"""


@query(_between("b.ds > a.ds", "b.de < a.de"))
def direct_path_edges(spark, sf):
    nodes = part_landscape(spark, sf)
    return P.max_min_edges(nodes, P.hamming_edges(nodes, 5), "AAAAA", "CGCGC", 5, bypasses=False)


@query(_between("b.ds >= a.ds", "b.de <= a.de", "AND b.y >= a.y"))
def monotone_bypass_edges(spark, sf):
    nodes = part_landscape(spark, sf)
    return P.max_min_edges(nodes, P.hamming_edges(nodes, 5), "AAAAA", "CGCGC", 5, bypasses=True, monotonic=True)


# --- joins ---------------------------------------------------------------------------------

@query(f"""WITH {CUSTOMER} SELECT row_id, CAST(row_id % 65536 AS BIGINT) AS idx FROM customer_dna""")
def state_index_lookup(spark, sf):
    space = P.Space.regular(CUSTOMER_LENGTH, "ACGT")
    return customer_dna(spark, sf).select("row_id", space.idx_of("seq").alias("idx"))


@query(f"""WITH {PART} SELECT l_orderkey, l_linenumber, round(y, 6) AS y FROM lineitem JOIN part_landscape ON idx = l_partkey % 1024""")
def values_at_labels(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", dna_digits(F.col("l_partkey"), 5).alias("seq"))
    return S.genotypes(part_landscape(spark, sf), li.withColumn("pos", F.struct("l_orderkey", "l_linenumber")), "seq").select("pos.l_orderkey", "pos.l_linenumber", r6("y").alias("y"))


_AA = f"""codons(c, r) AS (VALUES {CODONS}), word AS (SELECT substr('TCAG', CAST(p_partkey//16%4 AS INT)+1, 1) || substr('TCAG', CAST(p_partkey//4%4 AS INT)+1, 1)
   || substr('TCAG', CAST(p_partkey%4 AS INT)+1, 1) AS c, p_size FROM part),
  protein AS (SELECT r AS seq, avg(p_size) AS y FROM word JOIN codons USING (c) GROUP BY 1)"""


def protein_landscape(spark, sf):
    """``(seq, y)``: mean part size per residue encoded by the part key modulo 64."""
    from terrane.functions.seqcols import translate
    word = P.Space.regular(3, "TCAG").seq_of(F.pmod("p_partkey", P.int64(64)))
    return table(spark, sf, "part").groupBy(translate(word).alias("seq")).agg(F.avg("p_size").alias("y"))


@query(f"""WITH {_AA}, s AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY*', '')) AS seq)
  SELECT s.seq, CASE WHEN s.seq = '*' THEN -1.5 ELSE round(p.y, 6) END AS y FROM s LEFT JOIN protein p USING (seq)""")
def values_with_stop(spark, sf):
    """Values on the whole residue space; stops take a fixed value."""
    space = P.Space(("ACDEFGHIKLMNPQRSTVWY*",))
    full = P.require_complete(P.attach_values(space, space.states(spark), protein_landscape(spark, sf), stop_y=-1.5))
    return full.select("seq", r6("y").alias("y"))


@query(f"""WITH {CUSTOMER} SELECT a.row_id AS i, b.row_id AS j FROM customer_dna a JOIN customer_dna b ON hamming(a.seq, b.seq) = 1""")
def mutation_self_join(spark, sf):
    """All pairs of customers one letter apart."""
    return P.hamming_edges(customer_dna(spark, sf).withColumnRenamed("row_id", "idx"), CUSTOMER_LENGTH, copies=True)


@query(f"""WITH {CUSTOMER}, f AS (SELECT row_id, seq FROM customer_dna WHERE y > 9900)
  SELECT row_id AS idx, CAST(d AS BIGINT) AS hops FROM (SELECT c.row_id, min(hamming(c.seq, f.seq)) AS d FROM customer_dna c, f GROUP BY 1) WHERE d <= 1
  UNION SELECT b.row_id, 2 FROM customer_dna a JOIN customer_dna b ON hamming(a.seq, b.seq) = 1 WHERE EXISTS (SELECT 1 FROM f WHERE hamming(a.seq, f.seq) = 1)
    AND NOT EXISTS (SELECT 1 FROM f WHERE hamming(b.seq, f.seq) <= 1)""")
def two_hop_neighbours(spark, sf):
    nodes = customer_dna(spark, sf).withColumnRenamed("row_id", "idx")
    out = P.neighbourhood(P.hamming_edges(nodes, CUSTOMER_LENGTH, listed=False), nodes.where("y > 9900"), 2)
    return out.select("idx", F.col("hops").cast("bigint").alias("hops"))


@query(f"""WITH {_AA} SELECT w.c AS seq, r AS protein, round(y, 6) AS y FROM codons w JOIN protein p ON p.seq = w.r""")
def nucleotide_landscape(spark, sf):
    _, nodes = P.to_nucleotide_space(protein_landscape(spark, sf), 1, spark)
    return nodes.select("seq", "protein", r6("y").alias("y"))


@query(f"WITH {PART} SELECT t.i AS idx FROM range(1024) t(i) ANTI JOIN (SELECT o_totalprice_key AS i FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) * 31 % 1024 AS o_totalprice_key FROM orders)) l ON l.i = t.i")
def unobserved_states(spark, sf):
    """States that no order falls on."""
    seen = table(spark, sf, "orders").select(F.pmod(F.floor("o_totalprice").cast("bigint") * 31, P.int64(1024)).alias("idx"))
    return S.complement(PART_SPACE.states(spark), seen).select("idx")


@query(f"""WITH {PART}, f AS (SELECT y FROM part_landscape WHERE seq = 'ACGTA'),
  m AS (SELECT CAST(s AS BIGINT) AS site, a AS allele, substr('ACGTA', 1, CAST(s AS INT)) || a || substr('ACGTA', CAST(s AS INT)+2) AS seq
    FROM range(5) t(s), (SELECT unnest(string_split('ACGT', '')) AS a)),
  e AS (SELECT site, allele, p.y, p.y - f.y AS effect FROM m JOIN part_landscape p USING (seq), f)
  SELECT site, allele, round(effect, 6) AS effect, round(effect - avg(effect) OVER (PARTITION BY site), 6) AS centred FROM e""")
def single_mutant_effects(spark, sf):
    nodes = part_landscape(spark, sf)
    raw = S.single_mutants(nodes, PART_SPACE, "ACGTA")
    centred = S.single_mutants(nodes, PART_SPACE, "ACGTA", centre=True).select("site", "allele", r6("effect").alias("centred"))
    return raw.select("site", "allele", r6("effect").alias("effect")).join(centred, ["site", "allele"]).withColumn("site", F.col("site").cast("bigint"))


@query(f"""WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[2] AS DOUBLE) AS a2, CAST(embedding[3] AS DOUBLE) AS a3 FROM embeddings),
  s AS (SELECT * FROM (VALUES (0,1,1),(1,1,-1),(2,-1,1),(3,-1,-1)) t(combo, s1, s2)),
  d AS (SELECT combo, s1, s2, avg(sqrt((s1*a1 - (0.1*a3-a1))*(s1*a1 - (0.1*a3-a1)) + (s2*a2 - (a2+0.1*a3))*(s2*a2 - (a2+0.1*a3)))) AS distance FROM e, s GROUP BY 1,2,3)
  SELECT round(distance, 6) AS distance, s1 AS a1, s2 AS a2 FROM d ORDER BY d.distance, combo LIMIT 1""")
def axis_sign_alignment(spark, sf):
    e = lambda k: F.col("embedding")[k].cast("double")
    emb = table(spark, sf, "embeddings").withColumn("seq", F.col("vec_id").cast("string"))
    nodes = emb.select("seq", e(0).alias("a1"), e(1).alias("a2"))
    moved = emb.select("seq", (0.1 * e(2) - e(0)).alias("a1"), (e(1) + 0.1 * e(2)).alias("a2"))
    return S.sign_alignment(nodes, moved, ["a1", "a2"]).withColumn("distance", r6("distance"))


@query(f"""WITH {PART_EDGES} SELECT greatest(i, j) AS i, least(i, j) AS j, round(a.y, 6) AS y_i, round(b.y, 6) AS y_j
  FROM (SELECT DISTINCT greatest(i, j) AS i, least(i, j) AS j FROM edges) JOIN part_landscape a ON a.idx = i JOIN part_landscape b ON b.idx = j""")
def edge_coordinates(spark, sf):
    nodes = part_landscape(spark, sf)
    e = S.edge_coordinates(nodes, P.hamming_edges(nodes, 5), ["y"])
    return e.select("i", "j", r6("y_i").alias("y_i"), r6("y_j").alias("y_j"))


@query(f"""WITH {LINE}, s AS (SELECT idx FROM line_landscape WHERE y > 5.2), e AS (SELECT idx FROM line_landscape WHERE n > 1400)
  SELECT (SELECT count(*) FROM (SELECT idx FROM s INTERSECT SELECT idx FROM e)) AS shared, (SELECT count(*) FROM (SELECT idx FROM s UNION SELECT idx FROM e)) AS either,
   (SELECT count(*) FROM line_landscape WHERE idx NOT IN (SELECT idx FROM s)) AS outside""")
def state_set_operations(spark, sf):
    nodes = line_landscape(spark, sf)
    s, e = nodes.where("y > 5.2"), nodes.where("n > 1400")
    shared = s.select("idx").intersect(e.select("idx")).agg(F.count("*").alias("shared"))
    return shared.withColumn("either", S.union_states(s, e).agg(F.count("*")).scalar()).withColumn("outside", S.complement(nodes, s).agg(F.count("*")).scalar())


# --- edge tables, sorting, sampling ------------------------------------------------------------

@query(f"WITH {LINE_EDGES} SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS edge_id FROM edges WHERE j > i")
def numbered_triangular_edges(spark, sf):
    edges = P.hamming_edges(line_landscape(spark, sf), 3)
    return T.with_edge_id(edges.where("j > i"))


@query(f"WITH {PART_EDGES} SELECT i, j FROM edges")
def symmetric_edges(spark, sf):
    return T.symmetric(P.hamming_edges(part_landscape(spark, sf), 5).where("j > i"))


@query(f"WITH {PART} SELECT idx, seq, round(y, 6) AS y FROM part_landscape ORDER BY y")
def sorted_nodes(spark, sf):
    return S.sort_nodes(part_landscape(spark, sf), color="y").select("idx", "seq", r6("y").alias("y"))


@query(f"WITH {CUSTOMER} SELECT row_id FROM customer_dna ORDER BY md5('7:' || row_id) LIMIT 200")
def sampled_rows(spark, sf):
    from terrane.operators.splits import sample_rows
    return sample_rows(customer_dna(spark, sf), 200, seed=7, key="row_id").select("row_id")
