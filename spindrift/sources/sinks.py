"""Sinks: parquet parts with their sums, result tables, a store of leaf partials."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parts(df: DataFrame, path: str, by: Sequence[str], sums: Sequence[Column], parts: DataFrame | None = None) -> DataFrame:
    """Parquet parts by ``by`` under ``path``/parts, and each part's own sums under ``path``/summary.

    ``df`` is computed once, by the write; the sums are read from the columns of what was written.
    The summary has a row for every part, with ``rows`` and the part's schema; it is the sidecar of
    the part's files.  Of ``parts``, keys that must be there, those without rows get zeros.
    """
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/parts")
    spark = df.sparkSession
    written = spark.read.schema(df.schema).parquet(f"{path}/parts")
    rest = [f for f in df.schema.fields if f.name not in by]
    summary = written.groupBy(*by).agg(F.count("*").alias("rows"), *sums)
    if parts is not None:
        empty = parts.select(*by).distinct().join(summary.select(*by), list(by), "left_anti")
        zeros = [F.lit(0).cast(f.dataType).alias(f.name) if f.dataType.typeName() in ("long", "integer", "double", "float") else F.lit(None).cast(f.dataType).alias(f.name) for f in summary.schema.fields if f.name not in by]
        summary = summary.unionByName(empty.select(*by, *zeros))
    summary = summary.withColumn("part_schema", F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)))
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    return spark.read.parquet(f"{path}/summary")


def parts_and_totals(df: DataFrame, dataset: str, part: str, sums: Sequence[Column]) -> DataFrame:
    """Each part's sums, each dataset's and the run's, in one pass (G19); totals have null keys."""
    return df.rollup(dataset, part).agg(*sums)


def write_result(df: DataFrame, path: str) -> DataFrame:
    """The result as a parquet table, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which all executors share.

    Where the session names no folder, a local master is given a temporary one; on a cluster, where
    executors would not see it, an error says what to set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: one evaluation, also when executors are lost."""
    path = shared_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class PartialStore:
    """Per-leaf partials of a plan, kept under a folder, so a killed run resumes.

    A plan is known by a text that says what it computes; partials of other plans are never mixed in.
    """

    def __init__(self, spark: SparkSession, path: str, plan: str):
        self.spark = spark
        self.path = f"{path.rstrip('/')}/{hashlib.sha256(plan.encode()).hexdigest()[:32]}"

    def load(self, schema) -> DataFrame:
        """The partials so far; none when the store is empty."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def missing(self, leaves: DataFrame, schema, leaf: str = "leaf") -> DataFrame:
        """The rows of ``leaves`` whose leaf has no partial yet."""
        return leaves.join(self.load(schema).select(leaf), leaf, "left_anti")

    def add(self, partials: DataFrame) -> None:
        partials.write.mode("append").parquet(self.path)
