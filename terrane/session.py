"""Step tables of the iterative jobs, written to the folder named in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is made only where driver and tasks are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master == "local" or sc.master.startswith("local["):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


_SCOPES: list[list[Stored]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Remove the step tables written inside, once the block ends.

    Results are lazy and read these tables, so write or collect them inside the block.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for step in _SCOPES.pop():
            step.drop()


class Stored:
    """A table written to the checkpoint folder, with the measures taken while writing it."""

    def __init__(self, df: DataFrame, measures: dict[str, Column] | None = None):
        spark = df.sparkSession
        self.path = f"{checkpoint_folder(spark)}/terrane-{uuid.uuid4().hex}"
        schema = df.schema
        observation = Observation() if measures else None
        if measures:
            # the measures belong to the writing stage itself, so retried tasks count once
            df = df.observe(observation, *[c.alias(n) for n, c in measures.items()])
        df.write.parquet(self.path)
        taken = observation.get if measures else {}
        self.measures = {n: taken.get(n) for n in measures or {}}
        self.table = spark.read.schema(schema).parquet(self.path)
        for held in _SCOPES[-1:]:
            held.append(self)

    def drop(self) -> None:
        """Remove a step that nothing refers to any more."""
        spark = self.table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written table."""
    return Stored(df).table


def keep(df: DataFrame) -> DataFrame:
    """Cache with its lineage, so a lost executor only costs a recomputation."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def small_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table whose size is bounded by the alphabet or the sequence length."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows")
    return rows
