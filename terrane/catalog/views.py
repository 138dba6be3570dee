"""Landscapes and alignments derived from the given tables, in DataFrame code and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.constants import LETTERS
from terrane.functions.seqcols import computed_once
from terrane.operators.spaces import Space, int64

PART_SPACE = Space.regular(5, "ACGT")
LINE_SPACE = Space(("ANR", "FO", "1234567"))
EMBED_SPACE = Space.regular(8, "AB")
CUSTOMER_LENGTH = 8
ORDER_LENGTH = 12
MSA_LENGTH = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def normal_cdf_sql(z: str) -> str:
    """Normal distribution function by its odd power series, for values up to 30."""
    term = f"exp((2*k+1)*ln(greatest(abs({z}), 1e-300)) - (k+1)*ln(2) - lgamma(k+1.5) + 0.5*ln(pi()))"
    return f"CASE WHEN abs({z}) > 30 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + sign({z})*exp(-({z})*({z})/2)/sqrt(2*pi())*list_sum(list_transform(range(0, 900), lambda k: {term})) END"


def dna_digits(value: Column, length: int) -> Column:
    """Base-4 digits of an integer written with ACGT, highest first."""
    return Space.regular(length, "ACGT").seq_of(F.pmod(value, int64(4 ** length)))


def dna_digits_sql(value: str, length: int) -> str:
    return " || ".join(f"substr('ACGT', CAST(({value})//{4 ** (length - 1 - s)}%4 AS INT)+1, 1)" for s in range(length))


def part_landscape(spark: SparkSession, sf: str) -> DataFrame:
    """``(idx, seq, y, y_var, n)``: mean part size per base-4 word of the part key."""
    part = table(spark, sf, "part").select(F.pmod("p_partkey", int64(1024)).alias("idx"), "p_size")
    g = part.groupBy("idx").agg(
        F.avg("p_size").alias("y"), (F.var_samp("p_size") / F.count("*")).alias("y_var"), F.count("*").alias("n")
    )
    return g.select("idx", PART_SPACE.seq_of("idx").alias("seq"), "y", "y_var", "n")


PART = f"""part_landscape AS (
  SELECT idx, {dna_digits_sql('idx', 5)} AS seq, y, y_var, n FROM (
    SELECT p_partkey % 1024 AS idx, avg(p_size) AS y, var_samp(p_size)/count(*) AS y_var, count(*) AS n
    FROM part GROUP BY 1))"""


def part_vector(spark: SparkSession, sf: str) -> DataFrame:
    """``(idx, seq, v)``: 10 ln(1 + y) of the part landscape on all 1,024 states, zero where unobserved."""
    states = PART_SPACE.states(spark)
    values = part_landscape(spark, sf).select("idx", (10.0 * F.log(1.0 + F.col("y"))).alias("v"))
    return states.join(values, "idx", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


PART_VEC = PART + f""", part_vec AS (
  SELECT i AS idx, {dna_digits_sql('i', 5)} AS seq, coalesce(10.0*ln(1.0 + p.y), 0.0) AS v
  FROM range(1024) t(i) LEFT JOIN part_landscape p ON p.idx = i)"""


def line_landscape(spark: SparkSession, sf: str) -> DataFrame:
    """``(idx, seq, y, y_var, n)``: mean price (10,000s) per flag, status and line number (irregular)."""
    li = table(spark, sf, "lineitem")
    seq = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    price = F.col("l_extendedprice") / 10000.0
    g = li.select(seq.alias("seq"), price.alias("p")).groupBy("seq").agg(
        F.avg("p").alias("y"), (F.var_samp("p") / F.count("*")).alias("y_var"), F.count("*").alias("n")
    )
    return g.select(LINE_SPACE.idx_or_fail("seq").alias("idx"), "seq", "y", "y_var", "n")


LINE = """line_landscape AS (
  SELECT (instr('ANR', substr(seq,1,1))-1)*14 + (instr('FO', substr(seq,2,1))-1)*7 + instr('1234567', substr(seq,3,1))-1 AS idx,
         seq, y, y_var, n FROM (
    SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS seq, avg(l_extendedprice/10000.0) AS y,
           var_samp(l_extendedprice/10000.0)/count(*) AS y_var, count(*) AS n
    FROM lineitem GROUP BY 1))"""


def embed_landscape(spark: SparkSession, sf: str) -> DataFrame:
    """``(idx, seq, y, y_var, n)``: mean ninth component per sign pattern of the first eight (incomplete)."""
    e = table(spark, sf, "embeddings")
    seq = F.concat(*[F.when(F.col("embedding")[s] > 0, "B").otherwise("A") for s in range(8)])
    g = e.select(seq.alias("seq"), (F.col("embedding")[8].cast("double") * 10.0).alias("v")).groupBy("seq").agg(
        F.avg("v").alias("y"), (F.var_samp("v") / F.count("*")).alias("y_var"), F.count("*").alias("n")
    )
    return g.select(EMBED_SPACE.idx_or_fail("seq").alias("idx"), "seq", "y", "y_var", "n")


EMBED_SEQ = " || ".join(f"CASE WHEN embedding[{s + 1}] > 0 THEN 'B' ELSE 'A' END" for s in range(8))
EMBED_IDX = " + ".join(f"CASE WHEN substr(seq,{s + 1},1) = 'B' THEN {2 ** (7 - s)} ELSE 0 END" for s in range(8))
EMBED = f"""embed_landscape AS (
  SELECT {EMBED_IDX} AS idx, seq, y, y_var, n FROM (
    SELECT {EMBED_SEQ} AS seq, avg(CAST(embedding[9] AS DOUBLE)*10.0) AS y,
           var_samp(CAST(embedding[9] AS DOUBLE)*10.0)/count(*) AS y_var, count(*) AS n
    FROM embeddings GROUP BY 1))"""


def line_msa(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, seq, w)``: one five-letter sequence per line item."""
    li = table(spark, sf, "lineitem")
    letter = lambda c: F.substr(F.lit(LETTERS), F.round(F.col(c) * 100).cast("int") + 1, F.lit(1))
    seq = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"), letter("l_discount"), letter("l_tax"))
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("w"), "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax")
    return computed_once(rows, "seq", seq).select("row_id", "seq", "w")


MSA = f"""line_msa AS (
  SELECT l_orderkey*8 + l_linenumber AS row_id, l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR)
      || substr('{LETTERS}', CAST(round(l_discount*100) AS INT)+1, 1)
      || substr('{LETTERS}', CAST(round(l_tax*100) AS INT)+1, 1) AS seq, l_quantity AS w
  FROM lineitem)"""


def customer_dna(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, seq, y)``: eight-letter DNA word per customer key, account balance as value."""
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("y"))
    return computed_once(rows, "seq", dna_digits(F.col("row_id"), CUSTOMER_LENGTH)).select("row_id", "seq", "y")


CUSTOMER = f"customer_dna AS (SELECT c_custkey AS row_id, {dna_digits_sql('c_custkey', CUSTOMER_LENGTH)} AS seq, c_acctbal AS y FROM customer)"


def order_dna(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, seq, y)``: twelve-letter DNA word per order key, total price as value."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"))
    return computed_once(rows, "seq", dna_digits(F.col("row_id") * 7919, ORDER_LENGTH)).select("row_id", "seq", "y")


ORDER = f"order_dna AS (SELECT o_orderkey AS row_id, {dna_digits_sql('o_orderkey*7919', ORDER_LENGTH)} AS seq, o_totalprice AS y FROM orders)"
