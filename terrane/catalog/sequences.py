"""Column derivations over the order, customer and line-item sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.views import CUSTOMER, CUSTOMER_LENGTH, LINE, MSA, MSA_LENGTH, ORDER, ORDER_LENGTH, PART, customer_dna, line_landscape, line_msa, order_dna, part_landscape, r6, table
from terrane.constants import DNA, DNA_AMBIGUITY, PROTEIN, RNA, codon_table
from terrane.functions import seqcols as S
from terrane.operators import msa as M
from terrane.operators.spaces import site_alleles

FOCAL = "ACGTACGTACGT"
RECODE = [{"A": "R", "G": "R", "C": "Y", "T": "Y"}, {"A": "W", "T": "W"}] * 6
CODONS = ", ".join(f"('{c}','{r}')" for c, r in codon_table().items())
CODES = ", ".join(f"('{c}',{o},'{a}')" for c, v in DNA_AMBIGUITY.items() for o, a in enumerate(v))


@query(f"WITH {ORDER} SELECT row_id, CAST(hamming(seq, '{FOCAL}') AS BIGINT) AS d FROM order_dna")
def hamming_distance(spark, sf):
    return order_dna(spark, sf).select("row_id", S.hamming("seq", F.lit(FOCAL), ORDER_LENGTH).cast("bigint").alias("d"))


@query(f"""WITH {ORDER} SELECT o.row_id, CAST(length(o.seq) - length(n.n_name) + (
    SELECT count(*) FROM range(1, least(length(o.seq), length(n.n_name)) + 1) t(s) WHERE substr(o.seq, s, 1) <> substr(n.n_name, s, 1)) AS BIGINT) AS d
  FROM order_dna o JOIN nation n ON o.row_id % 25 = n.n_nationkey""")
def hamming_distance_unequal_lengths(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    both = order_dna(spark, sf).withColumn("k", F.col("row_id") % 25).join(nation, "k")
    return both.select("row_id", S.hamming("seq", "n_name").cast("bigint").alias("d"))


@query(f"WITH {ORDER} SELECT row_id, substr(seq,2,1) || substr(seq,5,1) || substr(seq,12,1) AS sub FROM order_dna")
def subsequence_at_positions(spark, sf):
    return order_dna(spark, sf).select("row_id", S.subsequence("seq", [1, 4, 11]).alias("sub"))


@query(f"WITH {ORDER} SELECT row_id, translate(reverse(seq), 'UAGCNT[]', 'AUCGNA][') AS rc FROM order_dna")
def reverse_complement(spark, sf):
    return order_dna(spark, sf).select("row_id", S.reverse_complement("seq").alias("rc"))


_RECODE_SQL = " || ".join(
    f"CASE substr(seq,{s + 1},1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in d.items()) + " ELSE 'X' END"
    for s, d in enumerate(RECODE)
)


@query(f"WITH {ORDER} SELECT row_id, {_RECODE_SQL} AS coded FROM order_dna")
def recode_sites(spark, sf):
    return order_dna(spark, sf).select("row_id", S.recode("seq", RECODE).alias("coded"))


@query(f"""WITH {ORDER}, codons(c, r) AS (VALUES {CODONS})
  SELECT o.row_id, a.r || b.r || c.r || d.r AS protein FROM order_dna o
  JOIN codons a ON a.c = substr(seq,1,3) JOIN codons b ON b.c = substr(seq,4,3)
  JOIN codons c ON c.c = substr(seq,7,3) JOIN codons d ON d.c = substr(seq,10,3)""")
def translate_to_protein(spark, sf):
    return order_dna(spark, sf).select("row_id", S.translate("seq", length=ORDER_LENGTH).alias("protein"))


@query(f"""WITH {ORDER}, codons(c, r) AS (VALUES {CODONS})
  SELECT o.row_id, coalesce(a.r, '') || coalesce(b.r, '') || coalesce(c.r, '') AS protein FROM (SELECT row_id, substr(seq, 1, 3 + CAST(row_id % 8 AS INT)) AS w FROM order_dna) o
  LEFT JOIN codons a ON a.c = substr(w,1,3) LEFT JOIN codons b ON b.c = substr(w,4,3) LEFT JOIN codons c ON c.c = substr(w,7,3)""")
def translate_varied_lengths(spark, sf):
    """Sequences of different lengths; an incomplete last codon is left out."""
    words = order_dna(spark, sf).withColumn("w", F.substr("seq", F.lit(1), (F.col("row_id") % 8).cast("int") + 3))
    return words.select("row_id", S.translate("w").alias("protein"))


@query(f"""WITH {PART}, code AS (SELECT substr(seq,1,3) AS c, substr('ABCD*', CAST(sum(n) % 5 AS INT) + 1, 1) AS r FROM part_landscape GROUP BY 1),
  o AS (SELECT * FROM (WITH {ORDER} SELECT * FROM order_dna))
  SELECT o.row_id, coalesce(a.r,'X') || coalesce(b.r,'X') || coalesce(c.r,'X') || coalesce(d.r,'X') AS protein FROM o
  LEFT JOIN code a ON a.c = substr(seq,1,3) LEFT JOIN code b ON b.c = substr(seq,4,3)
  LEFT JOIN code c ON c.c = substr(seq,7,3) LEFT JOIN code d ON d.c = substr(seq,10,3)""")
def translate_with_custom_codons(spark, sf):
    letter = F.substr(F.lit("ABCD*"), (F.sum("n") % 5).cast("int") + 1, F.lit(1))
    rows = part_landscape(spark, sf).groupBy(F.translate(F.substring("seq", 1, 3), "T", "U").alias("Codon")).agg(letter.alias("Letter"))
    return order_dna(spark, sf).select("row_id", S.translate("seq", S.custom_codon_table(rows), ORDER_LENGTH).alias("protein"))


@query(f"""WITH {CUSTOMER} SELECT row_id, CAST(s AS BIGINT) AS site, substr(seq, CAST(s AS INT)+1, 1) AS allele
  FROM customer_dna, range({CUSTOMER_LENGTH}) t(s)""")
def one_hot_sparse(spark, sf):
    cells = S.one_hot(customer_dna(spark, sf), [DNA] * CUSTOMER_LENGTH)
    return cells.select("row_id", F.col("site").cast("bigint").alias("site"), "allele")


@query(f"WITH {LINE} SELECT idx, " + ", ".join(
    f"CAST(substr(seq,{s + 1},1) = '{a}' AS INT) AS s{s}_{a}" for s, site in enumerate(("ANR", "FO", "1234567")) for a in site
) + " FROM line_landscape")
def one_hot_wide(spark, sf):
    return line_landscape(spark, sf).select("idx", *S.one_hot_wide("seq", ("ANR", "FO", "1234567")))


def _in(letters):
    return "(" + ", ".join(f"'{a}'" for a in letters) + ")"


_TYPE = f"""CASE WHEN bool_and(a IN {_in(DNA)}) THEN 'dna' WHEN bool_and(a IN {_in(RNA)}) THEN 'rna'
  WHEN bool_and(a IN {_in(PROTEIN)}) THEN 'protein' ELSE 'custom' END"""


@query(f"""WITH {MSA}, c AS (SELECT * FROM (WITH {CUSTOMER} SELECT * FROM customer_dna)),
  cells AS (SELECT 'line' AS src, s AS site, substr(seq, CAST(s AS INT)+1, 1) AS a FROM line_msa, range({MSA_LENGTH}) t(s)
    UNION ALL SELECT 'customer', s, substr(seq, CAST(s AS INT)+1, 1) FROM c, range({CUSTOMER_LENGTH}) t(s))
  SELECT src, CAST(site AS BIGINT) AS site, {_TYPE} AS kind, CAST(count(DISTINCT a) AS BIGINT) AS n_alleles FROM cells GROUP BY 1, 2""")
def alphabet_type_per_site(spark, sf):
    cells = lambda df, src: df.select(F.lit(src).alias("src"), F.posexplode(F.split("seq", "")).alias("site", "a"))
    both = cells(line_msa(spark, sf), "line").unionByName(cells(customer_dna(spark, sf), "customer"))
    sets = both.groupBy("src", "site").agg(F.collect_set("a").alias("alleles"))
    return sets.select("src", F.col("site").cast("bigint").alias("site"), S.alphabet_type(F.col("alleles")).alias("kind"), F.size("alleles").cast("bigint").alias("n_alleles"))


@query(f"""WITH {MSA}, cells AS (SELECT substr(seq, CAST(s AS INT)+1, 1) AS a FROM line_msa, range({MSA_LENGTH}) t(s)),
  f AS (SELECT a, count(*)/sum(count(*)) OVER () AS f FROM cells GROUP BY 1),
  u AS (SELECT DISTINCT seq FROM line_msa)
  SELECT seq, round(sum(ln(f)), 6) AS logp FROM u, range({MSA_LENGTH}) t(s) JOIN f ON f.a = substr(seq, CAST(s AS INT)+1, 1) GROUP BY 1""")
def expected_log_probability(spark, sf):
    rows = line_msa(spark, sf)
    freqs = M.frequency_map(M.allele_frequencies(rows))
    return rows.select("seq").distinct().select("seq", r6(S.expected_logp("seq", freqs, MSA_LENGTH)).alias("logp"))


@query(f"""WITH {CUSTOMER}, codes(code, o, a) AS (VALUES {CODES}), p AS (SELECT row_id, translate(substr(seq,5,4), 'ACGT', 'NRYT') AS pattern FROM customer_dna)
  SELECT p.row_id, a.a || b.a || c.a || d.a AS seq FROM p JOIN codes a ON a.code = substr(pattern,1,1)
  JOIN codes b ON b.code = substr(pattern,2,1) JOIN codes c ON c.code = substr(pattern,3,1) JOIN codes d ON d.code = substr(pattern,4,1)""")
def expand_ambiguous_patterns(spark, sf):
    patterns = customer_dna(spark, sf).select("row_id", F.translate(F.substring("seq", 5, 4), "ACGT", "NRYT").alias("pattern"))
    return S.expand_pattern(patterns, "pattern", [DNA_AMBIGUITY] * 4).select("row_id", "seq")


@query("SELECT event_id, round(ln(exp(least(value*10.0, 500.0)))/100.0, 6) AS e, value*10.0 > 500 AS clamped FROM events")
def clamped_exponential(spark, sf):
    v = F.col("value") * 10.0
    e = table(spark, sf, "events")
    return e.select("event_id", r6(F.log(S.clamped_exp(v)) / 100.0).alias("e"), (v > 500).alias("clamped"))


@query(f"""WITH c AS (SELECT seq, CAST(sum(CASE WHEN f = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN f <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS s
    FROM (SELECT l_returnflag AS f, l_partkey % 1024 AS seq FROM lineitem) GROUP BY 1), w AS (SELECT * FROM c WHERE seq = 0)
  SELECT c.seq, round(ln((c.s+0.5)/(w.s+0.5)) - ln((c.i+0.5)/(w.i+0.5)), 6) AS y,
    round(1/(c.s+0.5) + 1/(c.i+0.5) + 1/(w.s+0.5) + 1/(w.i+0.5), 6) AS y_var FROM c, w""")
def enrichment_scores(spark, sf):
    li = table(spark, sf, "lineitem").select(F.pmod("l_partkey", F.lit(1024)).cast("bigint").alias("seq"), "l_returnflag")
    c = li.groupBy("seq").agg(F.count_if(F.col("l_returnflag") == "N").alias("i"), F.count_if(F.col("l_returnflag") != "N").alias("s"))
    w = c.where("seq = 0")
    y, y_var = S.enrichment("i", "s", w.select("i").scalar(), w.select("s").scalar())
    return c.select("seq", r6(y).alias("y"), r6(y_var).alias("y_var"))


@query(f"""WITH {PART}, m AS (SELECT min(y*y) AS lo, max(y*y) AS hi FROM part_landscape)
  SELECT idx, round(1.0 + y*y*(20.0-1.0)/(hi-lo), 6) AS size FROM part_landscape, m""")
def element_sizes(spark, sf):
    from terrane.operators.stats import element_sizes as sizes
    return sizes(part_landscape(spark, sf), "y", 1.0, 20.0).select("idx", r6("size").alias("size"))


@query("""WITH l AS (SELECT l_tax AS a, l_linenumber AS fold, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2)
  SELECT a, CAST(fold AS BIGINT) AS fold, CASE WHEN a = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(log10(a), 6) END AS log_a,
    CASE WHEN a = 0 THEN NULL ELSE round(sqrt(80.0/a), 6) END AS sd FROM l""")
def regularization_columns(spark, sf):
    losses = table(spark, sf, "lineitem").groupBy(F.col("l_tax").alias("a"), F.col("l_linenumber").cast("bigint").alias("fold")).agg(F.avg("l_discount").alias("loss"))
    return losses.select("a", "fold", F.round(S.log10_or_neg_inf("a"), 6).alias("log_a"), r6(S.a_to_sd(F.nullif("a", F.lit(0.0)), 80)).alias("sd"))


@query(f"WITH {ORDER} SELECT substr(seq,1,1) AS allele, CAST(sum(CAST(substr(seq,3,1)='G' AS INT)) AS BIGINT) AS n_g, count(*) AS n FROM order_dna GROUP BY 1")
def allele_indicator(spark, sf):
    o = order_dna(spark, sf).select(S.char_at("seq", 0).alias("allele"), S.allele_indicator("seq", 2, "G").alias("g"))
    return o.groupBy("allele").agg(F.sum("g").alias("n_g"), F.count("*").alias("n"))


@query(f"""WITH {MSA} SELECT CAST(s AS BIGINT) AS site, substr(seq, CAST(s AS INT)+1, 1) AS allele, min(row_id) AS first_seen
  FROM line_msa, range({MSA_LENGTH}) t(s) GROUP BY 1, 2""")
def alleles_per_site(spark, sf):
    return site_alleles(line_msa(spark, sf)).select(F.col("site").cast("bigint").alias("site"), "allele", "first_seen")
