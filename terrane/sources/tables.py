"""Readers and writers by file suffix: tables, edge lists, sequences, splits, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.operators.ranking import BUCKETS, ranked_by_bucket


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1]


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv (header row, key in the first column) or parquet (``parquet``, ``pq``)."""
    kind = suffix(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError(f"input format {kind} not recognized")


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    kind = suffix(path)
    if kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind in ("parquet", "pq"):
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"output format {kind} not recognized")


def read_edges(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else read_table(spark, path)


def write_edges(edges: DataFrame, path: str, triangular: bool = True, mode: str = "error") -> None:
    write_table(edges.where("j > i") if triangular else edges, path, mode)


def with_edge_id(edges: DataFrame) -> DataFrame:
    """Number the edges in (i, j) order, without a single-task sort."""
    width = F.greatest(F.ceil((edges.agg(F.max("i")).scalar() + 1) / BUCKETS), F.lit(1))
    return ranked_by_bucket(edges, F.floor(F.col("i") / width), ["i", "j"], "edge_id")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, other columns kept.

    A direction that is stored keeps its own columns; of several equal edges the smallest columns stay.
    """
    rest = [c for c in edges.columns if c not in ("i", "j")]
    own = edges.select("i", "j", F.lit(0).alias("_turned"), *rest)
    both = own.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("_turned"), *rest))
    kept = both.groupBy("i", "j").agg(F.min(F.struct("_turned", *rest)).alias("_e"))
    return kept.select("i", "j", *[F.col(f"_e.`{c}`").alias(c) for c in rest])


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One sequence per line."""
    return spark.read.text(path).select(F.trim("value").alias("seq")).where("seq <> ''")


def write_sequences(df: DataFrame, path: str, seq: str = "seq", mode: str = "error") -> None:
    df.select(F.col(seq).alias("value")).write.mode(mode).text(path)


def write_landscape_csv(nodes: DataFrame, path: str, mode: str = "error") -> None:
    write_table(nodes.select("seq", "y"), path, mode)


def write_embedding(prefix: str, nodes: DataFrame, decay_rates: DataFrame, edges: DataFrame | None = None,
                    nodes_format: str = "parquet", edges_format: str = "parquet", mode: str = "error") -> None:
    """``<prefix>.nodes.*``, ``<prefix>.decay_rates.csv`` and optionally ``<prefix>.edges.*``."""
    write_table(nodes, f"{prefix}.nodes.{nodes_format}", mode)
    write_table(decay_rates, f"{prefix}.decay_rates.csv", mode)
    if edges is not None:
        write_edges(edges, f"{prefix}.edges.{edges_format}", True, mode)


def write_splits(splits: DataFrame, path: str, mode: str = "error") -> None:
    """All splits as one table partitioned by split and role (test rows keep only the sequence)."""
    out = splits.withColumn("y", F.when(F.col("role") == "train", F.col("y")))
    if "y_var" in out.columns:
        out = out.withColumn("y_var", F.when(F.col("role") == "train", F.col("y_var")))
    out.write.mode(mode).partitionBy("split", "role").parquet(path)


def read_splits(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    """Partition pruning reads only the wanted role."""
    df = spark.read.parquet(path)
    return df if role is None else df.where(F.col("role") == role)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all splits, labelled by the partition folder ``label=<split>``."""
    return spark.read.option("basePath", path).parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "error") -> None:
    predictions.write.mode(mode).partitionBy("label").parquet(path)
