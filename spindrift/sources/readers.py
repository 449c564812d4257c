"""Scans: parquet, in-memory tables, row ranges ("steps"), a partitioned source protocol."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; pruning and pushdown are Catalyst's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_memory(spark: SparkSession, data: pa.Table | list[dict], schema: str | None = None) -> DataFrame:
    """An in-memory Arrow table or list of records as a DataFrame (S3)."""
    return spark.createDataFrame(data, schema) if schema else spark.createDataFrame(data)


def step_bounds(rows: int, steps: int) -> list[tuple[int, int]]:
    """Half-open row ranges, contiguous, whose sizes differ by at most one."""
    if rows < 0 or steps < 1:
        raise ValueError("rows is at least 0 and steps at least 1")
    small, larger = divmod(rows, steps)
    edges = [0]
    for i in range(steps):
        edges.append(edges[-1] + small + (i < larger))
    return list(zip(edges, edges[1:]))


def step_of(row: Column, rows: int, steps: int) -> Column:
    """The step that holds a row index, for the bounds of step_bounds."""
    small, larger = divmod(rows, steps)
    edge = larger * (small + 1)
    return F.when(row < edge, F.floor(row / (small + 1))).otherwise(larger + F.floor((row - edge) / max(small, 1))).cast("int")


def with_file_row(df: DataFrame, name: str = "row_in_file") -> DataFrame:
    """The row's index within its parquet file; stable under any split planning."""
    return df.select("*", F.col("_metadata.row_index").alias(name))


def with_leaf(df: DataFrame, key: str, rows_per_leaf: int, leaf: str = "leaf_id") -> DataFrame:
    """A leaf id from the data itself, never from partitions: key div rows_per_leaf."""
    return df.withColumn(leaf, F.floor(F.col(key) / F.lit(rows_per_leaf)).cast("long"))


def dense_leaf(df: DataFrame, leaf: str, dense: str = "leaf_pos") -> DataFrame:
    """``df`` of one row a leaf with positions from 0 in leaf order."""
    return df.withColumn(dense, F.row_number().over(Window.orderBy(leaf)) - 1)


_warned: set[int] = set()


def warn_few_tasks(df: DataFrame) -> bool:
    """Warn, once a session, when a scan has fewer partitions than there are cores."""
    spark = df.sparkSession
    few = df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    if few and id(spark) not in _warned:
        _warned.add(id(spark))
        warnings.warn("fewer partitions than cores: part of the cluster will idle", stacklevel=2)
    return few


class _Part(InputPartition):
    def __init__(self, spec):
        super().__init__(spec)
        self.spec = spec


def register_source(spark: SparkSession, name: str, schema: str, partitions: Callable[[dict], list], read: Callable[[object, dict], Iterator[pa.RecordBatch]]) -> None:
    """A custom partitioned source (S4): ``partitions(options)`` on the driver, ``read(spec, options)``
    in a task, yielding Arrow batches.  Afterwards ``spark.read.format(name)`` reads it."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [_Part(s) for s in partitions(self.options)]

        def read(self, partition):
            yield from read(partition.spec, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
