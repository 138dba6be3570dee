"""Layered dataset store: one folder per dataset, one parquet folder per layer, read lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# fixed values: layer names
LAYERS = ("raw", "data", "landscape", "nodes", "edges", "relaxation_times")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, path)
    return fs.exists(p)


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    p, fs = _folder(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


class DataSet:
    """Named bundle of layers under a root folder; layers given in memory take precedence."""

    def __init__(self, spark: SparkSession, root: str, name: str, **layers: DataFrame):
        unknown = set(layers) - set(LAYERS)
        if unknown:
            raise ValueError(f"unknown layers {sorted(unknown)}")
        if not layers and name not in list_datasets(spark, root):
            raise ValueError(f"dataset {name} not found, choose from {list_datasets(spark, root)}")
        self.spark, self.root, self.name, self.layers = spark, root, name, dict(layers)

    def path(self, layer: str) -> str:
        return f"{self.root}/{self.name}/{layer}"

    def layer(self, layer: str) -> DataFrame:
        if layer not in self.layers:
            if not exists(self.spark, self.path(layer)):
                raise ValueError(f"layer {layer} of {self.name} not available")
            self.layers[layer] = self.spark.read.parquet(self.path(layer))
        return self.layers[layer]

    @cached_property
    def available(self) -> list[str]:
        return [x for x in LAYERS if x in self.layers or exists(self.spark, self.path(x))]

    def save(self, mode: str = "error") -> None:
        for layer, df in self.layers.items():
            df.write.mode(mode).parquet(self.path(layer))
