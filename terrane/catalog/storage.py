"""Sources and sinks: whole tables written to the checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.selections import LINE_EDGES, PART_EDGES
from terrane.catalog.views import CUSTOMER, LINE, ORDER, PART, customer_dna, line_landscape, order_dna, part_landscape, r6, table
from terrane.operators import spaces as P, splits as X
from terrane.session import checkpoint_folder
from terrane.sources import tables as T
from terrane.sources.datasets import DataSet, list_datasets


def scratch(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}/{name}"


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def parquet_table(spark, sf):
    return T.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {CUSTOMER} SELECT seq, row_id, y FROM customer_dna")
def csv_round_trip(spark, sf):
    path = scratch(spark, "table.csv")
    T.write_table(customer_dna(spark, sf).select("seq", "row_id", "y"), path)
    return T.read_table(spark, path, "seq string, row_id bigint, y double")


@query(f"WITH {PART_EDGES} SELECT i, j FROM edges")
def edges_round_trip(spark, sf):
    """One direction is stored; both come back."""
    path = scratch(spark, "edges.parquet")
    T.write_edges(P.hamming_edges(part_landscape(spark, sf), 5), path)
    return T.symmetric(T.read_edges(spark, path))


@query(f"WITH {ORDER} SELECT seq FROM order_dna")
def sequence_lines_round_trip(spark, sf):
    path = scratch(spark, "sequences.txt")
    T.write_sequences(order_dna(spark, sf), path)
    return T.read_sequences(spark, path)


@query(f"WITH {PART} SELECT seq, round(y, 6) AS y FROM part_landscape")
def landscape_csv_round_trip(spark, sf):
    path = scratch(spark, "landscape.csv")
    T.write_landscape_csv(part_landscape(spark, sf), path)
    return T.read_table(spark, path, "seq string, y double").select("seq", r6("y").alias("y"))


@query(f"""WITH {CUSTOMER}, r AS (SELECT row_id, y, row_number() OVER (ORDER BY md5('3:' || row_id)) - 1 AS r, count(*) OVER () AS n FROM customer_dna),
  f AS (SELECT row_id, y, r // CAST(round(n/5.0) AS BIGINT) AS fold FROM r)
  SELECT s AS split, count(*) AS n, round(sum(y), 4) AS y FROM f, range(5) t(s) WHERE fold <> s GROUP BY 1""")
def split_files_round_trip(spark, sf):
    """Training parts of all splits, read through partition folders."""
    path = scratch(spark, "splits")
    T.write_splits(X.fold_roles(X.assign_folds(customer_dna(spark, sf), 5, 3, "row_id"), 5), path)
    train = T.read_splits(spark, path, "train")
    return train.groupBy(F.col("split").cast("bigint").alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("y"))


@query("SELECT l_returnflag AS label, l_partkey % 1024 AS seq, round(avg(l_quantity), 6) AS ypred FROM lineitem GROUP BY 1, 2")
def prediction_files_round_trip(spark, sf):
    path = scratch(spark, "predictions")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label"), (F.col("l_partkey") % 1024).alias("seq"))
    T.write_predictions(li.agg(F.avg("l_quantity").alias("ypred")), path)
    return T.read_predictions(spark, path).select("label", "seq", r6("ypred").alias("ypred"))


@query(f"""WITH {LINE_EDGES} SELECT 'nodes' AS part, count(*) AS n FROM line_landscape UNION ALL SELECT 'edges', count(*) FROM edges WHERE j > i
  UNION ALL SELECT 'decay_rates', count(DISTINCT l_linenumber) FROM lineitem""")
def embedding_tables_round_trip(spark, sf):
    prefix = scratch(spark, "walk")
    nodes = line_landscape(spark, sf)
    decay = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_tax").alias("decay_rates"))
    T.write_embedding(prefix, nodes, decay, P.hamming_edges(nodes, 3), nodes_format="csv")
    n = lambda part, kind: T.read_table(spark, f"{prefix}.{part}.{kind}").agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return n("nodes", "csv").unionByName(n("edges", "parquet")).unionByName(n("decay_rates", "csv"))


@query(f"""WITH {LINE_EDGES} SELECT 'lines' AS dataset, 'landscape' AS layer, count(*) AS n FROM line_landscape UNION ALL SELECT 'lines', 'edges', count(*) FROM edges
  UNION ALL SELECT 'lines', 'data', count(*) FROM lineitem""")
def dataset_layers(spark, sf):
    """Layers saved under a dataset folder and listed and read again."""
    root = scratch(spark, "datasets")
    nodes = line_landscape(spark, sf)
    DataSet(spark, root, "lines", data=table(spark, sf, "lineitem"), landscape=nodes, edges=P.hamming_edges(nodes, 3)).save()
    out = None
    for name in list_datasets(spark, root):
        stored = DataSet(spark, root, name)
        for layer in stored.available:
            part = stored.layer(layer).agg(F.lit(name).alias("dataset"), F.lit(layer).alias("layer"), F.count("*").alias("n"))
            out = part if out is None else out.unionByName(part)
    return out
