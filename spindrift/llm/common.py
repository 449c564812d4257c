"""Shared helpers of the training-data operators: table access, lineage cuts, argument checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; read through Spark only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one, a local master is given a temporary folder; on a cluster,
    where executors would not see it, an error says what to set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spindrift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and keeps column pruning for later readers.  The
    files go with ``release`` or, where a result still reads them, when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    shared = shared_dir(spark).rstrip("/").removeprefix("file://")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if shared in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def default_parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-bound work: the shuffle setting, at least the cluster's cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def require(df: DataFrame, *names: str) -> None:
    """Raise a readable error when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with those of ``df`` (letter case ignored)."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def words_text(column: Column) -> Column:
    """``column`` as a string, with null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))
