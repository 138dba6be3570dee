"""Plot-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.selections import LINE_EDGES, PART_EDGES
from terrane.catalog.views import LINE, LINE_SPACE, ORDER, PART, PART_SPACE, line_landscape, order_dna, part_landscape, r6, table
from terrane.operators import plotdata as D, spaces as P, stats as S

_XY = "xy AS (SELECT event_id AS idx, CAST(user_id AS DOUBLE) AS x, value AS y, value AS c FROM events)"
_PX = """px AS (SELECT idx, c, least(CAST(floor((x-x0)/sx*floor(40*sx/sy)) AS BIGINT), CAST(floor(40*sx/sy) AS BIGINT)-1) AS px, least(CAST(floor((y-y0)/sy*floor(40*sy/sx)) AS BIGINT), CAST(floor(40*sy/sx) AS BIGINT)-1) AS py
  FROM xy, (SELECT min(x) AS x0, max(x)-min(x) AS sx, min(y) AS y0, max(y)-min(y) AS sy FROM xy))"""


def points(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("idx"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), F.col("value").alias("c"))


@query(f"""WITH {LINE_EDGES}, u AS (SELECT DISTINCT greatest(i,j) AS i, least(i,j) AS j FROM edges)
  SELECT i, j, 0::BIGINT AS "end", round(y, 6) AS y, n FROM u JOIN line_landscape ON idx = i UNION ALL SELECT i, j, 1, round(y, 6), n FROM u JOIN line_landscape ON idx = j""")
def edge_segments(spark, sf):
    nodes = line_landscape(spark, sf)
    out = D.segments(nodes, P.hamming_edges(nodes, 3), ["y", "n"])
    return out.select("i", "j", F.col("end").cast("bigint").alias("end"), r6("y").alias("y"), "n")


@query(f"WITH {_XY}, {_PX} SELECT px, py, arg_min(c, idx) AS c FROM px GROUP BY 1, 2")
def node_raster_first(spark, sf):
    return D.node_raster(points(spark, sf), "x", "y", 40, "c")


@query(f"WITH {_XY}, {_PX} SELECT px, py, round(sum(c), 6) AS c FROM px GROUP BY 1, 2")
def node_raster_sum(spark, sf):
    return D.node_raster(points(spark, sf), "x", "y", 40, "c", "sum").withColumn("c", r6("c"))


@query(f"WITH {_XY}, {_PX} SELECT px, py, max(c) AS c FROM px GROUP BY 1, 2")
def node_raster_max(spark, sf):
    return D.node_raster(points(spark, sf), "x", "y", 40, "c", "max")


_EDGE_PX = f"""{LINE_EDGES}, xy AS (SELECT idx, CAST(n AS DOUBLE)/100.0 AS x, y*10.0 AS y, n AS c FROM line_landscape), {_PX},
  l AS (SELECT i, j, a.px AS xi, a.py AS yi, b.px - a.px AS dx, b.py - a.py AS dy, greatest(abs(b.px-a.px), abs(b.py-a.py)) AS n FROM edges JOIN px a ON a.idx = i JOIN px b ON b.idx = j),
  w AS (SELECT i, j, xi + CAST(sign(dx)*floor(abs(dx)*k/greatest(n,1)+0.5) AS BIGINT) AS px, yi + CAST(sign(dy)*floor(abs(dy)*k/greatest(n,1)+0.5) AS BIGINT) AS py FROM l, unnest(range(0, n+1)) t(k))"""


def line_points(spark, sf):
    return line_landscape(spark, sf).select("idx", "seq", (F.col("n") / 100.0).alias("x"), (F.col("y") * 10.0).alias("y"))


@query(f"WITH {_EDGE_PX} SELECT px, py, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY 1, 2")
def edge_raster_sum(spark, sf):
    edges = P.hamming_edges(line_landscape(spark, sf), 3)
    return D.edge_raster(line_points(spark, sf), edges, "x", "y", 40)


@query(f"WITH {_EDGE_PX} SELECT px, py, CAST(arg_min(i*42 + j, i*42 + j) AS BIGINT) AS c FROM w GROUP BY 1, 2")
def edge_raster_first(spark, sf):
    edges = P.hamming_edges(line_landscape(spark, sf), 3).withColumn("e", F.col("i") * 42 + F.col("j"))
    return D.edge_raster(line_points(spark, sf), edges, "x", "y", 40, "e", only_first=True)


@query("""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice)-min(l_extendedprice) AS span FROM lineitem)
  SELECT least(CAST(floor((l_extendedprice-lo)/span*50) AS BIGINT), 49) AS bin, count(*) AS n, round((least(floor((l_extendedprice-lo)/span*50), 49)+0.5)/50.0, 6) AS centre FROM lineitem, m GROUP BY 1, 3""")
def value_histogram(spark, sf):
    out = D.histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return out.select(F.col("bin").cast("bigint").alias("bin"), "n", r6("centre").alias("centre"))


@query(f"""WITH {PART}, f AS (SELECT idx, CASE WHEN n < 3 THEN 0.0 ELSE n*1.0 END AS frequency, y + 1.0 AS q FROM part_landscape), m AS (SELECT min(log10(frequency)) - 0.5 AS lo FROM f WHERE frequency > 0)
  SELECT idx, round(CASE WHEN frequency > 0 THEN log10(frequency) ELSE lo END, 6) AS "logR", round(log10(q), 6) AS "logQ", frequency > 0 AS observed FROM f, m""")
def density_against_frequency(spark, sf):
    d = part_landscape(spark, sf).select("idx", F.when(F.col("n") < 3, 0.0).otherwise(F.col("n") * 1.0).alias("frequency"), (F.col("y") + 1.0).alias("Q_star"))
    return D.density_scatter(d).select("idx", r6("logR").alias("logR"), r6("logQ").alias("logQ"), "observed")


@query(f"WITH {_XY}, m AS (SELECT least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM xy) SELECT round(lo - 0.05*(hi-lo), 6) AS axis_min, round(hi + 0.05*(hi-lo), 6) AS axis_max FROM m")
def axis_limits(spark, sf):
    return D.axis_limits(points(spark, sf), ["x", "y"]).select(r6("axis_min").alias("axis_min"), r6("axis_max").alias("axis_max"))


@query("SELECT CAST(1.0 AS DOUBLE) AS vmin, max(value) AS vmax FROM events")
def color_limits(spark, sf):
    return D.color_limits(points(spark, sf), "c", vmin=1.0)


@query(f"""WITH {PART} SELECT CAST(s AS BIGINT) AS site, a AS allele, idx, CAST(substr(seq, CAST(s AS INT)+1, 1) = a AS INT) AS has FROM part_landscape, range(5) t(s), (SELECT unnest(['A','C','G','T']) AS a)""")
def allele_grid(spark, sf):
    return D.allele_grid(part_landscape(spark, sf), PART_SPACE.alleles).withColumn("site", F.col("site").cast("bigint"))
