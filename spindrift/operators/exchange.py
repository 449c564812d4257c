"""Key exchange with a pinned route, ordered contents, and size rebalancing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.sinks import staged


def route(key: Column, parts: int) -> Column:
    """The destination of a 64-bit key: first 8 bytes of SHA-256 over its big-endian bytes, mod parts.

    Keys are unsigned; those from 2^63 up are negative longs here.  Null keys go to 0.
    """
    if parts < 1:
        raise ValueError("parts is at least 1")
    raw = F.unhex(F.lpad(F.hex(key.cast("long")), 16, "0"))
    head = F.conv(F.substring(F.sha2(raw, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.pmod(head, F.lit(parts).cast("decimal(20,0)")).cast("int"), F.lit(0))


def repartition_by_key(df: DataFrame, key: str, parts: int, order: Sequence[str] = (), dest: str = "dest") -> DataFrame:
    """Rows placed on the partition that ``route`` names, in ascending ``order`` within it.

    One exchange.  ``dest`` holds the place; it equals spark_partition_id() where AQE does not merge
    partitions.
    """
    placed = df.withColumn(dest, route(F.col(key), parts)).repartitionById(parts, F.col(dest))
    return placed.sortWithinPartitions(dest, *order) if order else placed


def fingerprint(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, rows, digest): a SHA-256 of each destination's rows in order, the same in every run.

    Rows are digested one by one; a destination's digests stream in order through one task, which
    holds a running hash and no list.  Rows alike in ``order`` are taken by their digests.
    """
    kind = df.schema[by].dataType.simpleString()
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    sorted_ = df.select(by, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], row.alias("__d")).repartition(F.col(by)).sortWithinPartitions(by, *[f"__o{i}" for i in range(len(order))], "__d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, running, started = None, 0, hashlib.sha256(), False
        out: list[tuple] = []
        for batch in batches:
            for dest, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if started and dest != now:
                    out.append((now, count, running.hexdigest()))
                    count, running = 0, hashlib.sha256()
                now, started = dest, True
                count += 1
                running.update(digest.encode())
            if len(out) >= 4096:
                yield rows_of(out)
                out = []
        if started:
            out.append((now, count, running.hexdigest()))
        yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        names = [by, "rows", "digest"]
        schema = pa.schema([(by, arrow), ("rows", pa.int64()), ("digest", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    arrow = to_arrow_type(df.schema[by].dataType)
    return sorted_.select(by, "__d").mapInArrow(run, f"`{by}` {kind}, rows long, digest string")


def producers(src: Column, sources: int, workers: int) -> Column:
    """Which of min(workers, sources) producers a source block goes to: contiguous, ascending."""
    t = max(1, min(workers, sources))
    small, larger = divmod(sources, t)
    edge = larger * (small + 1)
    return F.when(src < edge, F.floor(src / (small + 1))).otherwise(larger + F.floor((src - edge) / max(small, 1))).cast("int")


def rebalance_by_size(df: DataFrame, order: Sequence[str], size: Column, target: int, chunk: str = "bucket") -> DataFrame:
    """Rows in their order with a bucket number: each bucket starts a multiple of ``target`` on.

    The running size comes from range partitions: sums of whole partitions first, then within each,
    so no window holds all rows.  The ranges are drawn by sampling, so their outcome is written once
    and read by both passes.
    """
    if target < 1:
        raise ValueError("target is at least 1")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.withColumn("__size", size.cast("long")).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    return _running(ranged, order, "__size", "__part").withColumn(chunk, F.floor((F.col("__upto") - F.col("__size")) / F.lit(target)).cast("long")).drop("__size", "__part", "__upto")


def _running(ranged: DataFrame, order: Sequence[str], size: str, part: str) -> DataFrame:
    sums = ranged.groupBy(part).agg(F.sum(size).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(part).alias("__p"), "__before")
    within = F.sum(size).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("__within", within).join(F.broadcast(before), F.col(part) == F.col("__p"))  # one row a partition
    return joined.withColumn("__upto", F.col("__before") + F.col("__within")).drop("__within", "__before", "__p")


def rebalance(df: DataFrame) -> DataFrame:
    """Partitions of the advisory size where order does not matter: skewed ones split, small ones merged."""
    return df.hint("rebalance")


def union_blocks(*blocks: DataFrame) -> DataFrame:
    """Blocks behind each other with their ordinal as ``src_pid``."""
    out = None
    for i, b in enumerate(blocks):
        part = b.withColumn("src_pid", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no blocks")
    return out
