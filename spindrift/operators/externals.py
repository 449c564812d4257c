"""Opaque evaluators with a content-hashed payload, per-partition user code, binned lookups."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import rebalance_by_size


@dataclass(frozen=True)
class External:
    """An evaluator (U5): ``load`` turns the payload into a resource, once for each task.

    ``evaluate(resource, table)`` maps an Arrow table to one with the declared schema.
    """

    name: str
    payload: bytes
    load: Callable[[bytes], object]
    evaluate: Callable[[object, pa.Table], pa.Table]
    schema: str
    #: The digest that a plan records; a payload of another is refused, here and in each task.
    expected: str | None = None

    def __post_init__(self):
        if self.expected is not None and self.digest != self.expected:
            raise ValueError(f"{self.name}: payload {self.digest[:12]} is not the recorded {self.expected[:12]}")

    @property
    def digest(self) -> str:
        """SHA-256 of the payload: the evaluator's identity in a plan."""
        return hashlib.sha256(self.payload).hexdigest()

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` through the evaluator, batch by batch."""
        shared = df.sparkSession.sparkContext.broadcast(self.payload)
        load, evaluate, name, digest = self.load, self.evaluate, self.name, self.digest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if hashlib.sha256(shared.value).hexdigest() != digest:
                raise ValueError(f"{name}: the payload that reached the task is not the one of the plan")
            resource = load(shared.value)
            for batch in batches:
                yield from evaluate(resource, pa.Table.from_batches([batch])).to_batches()

        return df.mapInArrow(run, self.schema)

    def sample(self, table: pa.Table) -> pa.Table:
        """The evaluator tried on a small table on the driver, before a plan is made of it."""
        return self.evaluate(self.load(self.payload), table)


def retrying(fn: Callable, extra: int) -> Callable:
    """``fn`` tried up to ``extra`` more times in its worker before its error shows."""
    if extra < 0:
        raise ValueError("extra tries are at least 0")

    def tried(*args, **kwargs):
        for left in range(extra, -1, -1):
            try:
                return fn(*args, **kwargs)
            except Exception:
                if not left:
                    raise

    return tried


def map_leaves(df: DataFrame, leaf: str, process: Callable[[pa.Table], object], retries: int = 0, catch: bool = False) -> DataFrame:
    """(leaf, value, error): user code over each leaf's rows (U1); values are pickled bytes.

    With ``catch`` an error makes a dead letter instead of failing the job: see spend_failures.
    """
    call = retrying(process, retries)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        value = error = None
        try:
            value = pickle.dumps(call(group))
        except Exception as fault:
            if not catch:
                raise
            error = f"{type(fault).__name__}: {fault}"
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([value], pa.binary()), "error": pa.array([error], pa.string())})

    return df.withColumn("leaf", F.col(leaf).cast("long")).groupBy("leaf").applyInArrow(run, "leaf long, value binary, error string")


def combine_leaves(partials: DataFrame, combine: Callable, empty: Callable[[], object], fan: int = 64):
    """User partials folded pairwise in leaf order by the fixed tree, ``fan`` leaves a task and level.

    Only the last few partials reach the driver.
    """
    rows = partials.where(F.col("value").isNotNull()).select("leaf", "value")
    n = rows.count()
    if not n:
        return empty()
    # dense positions at every number of leaves, without one window over all
    placed = rebalance_by_size(rows, ["leaf"], F.lit(1), 1, "pos").select("value", "pos")
    level = fan.bit_length() - 1
    width = 1 << level

    def fold(items: list):
        while len(items) > 1:
            items = [combine(items[i], items[i + 1]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
        return items[0]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = group.sort_by("pos")
        value = fold([pickle.loads(v) for v in order.column("value").to_pylist()])
        return pa.table({"pos": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([pickle.dumps(value)], pa.binary())})

    placed = placed.select(F.col("pos").cast("long").alias("pos"), "value")
    while n > width:
        placed = placed.withColumn("group", F.floor(F.col("pos") / width).cast("long")).groupBy("group").applyInArrow(run, "pos long, value binary")
        n = -(-n // width)
    return fold([pickle.loads(r["value"]) for r in placed.orderBy("pos").collect()])


def binned_lookup(df: DataFrame, table: DataFrame, inputs: dict[str, tuple[str, str]], value: str, exact: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``value`` from the bin that holds its inputs.

    ``inputs`` names for each column the table's closed-open (lo, hi) columns; ``exact`` columns are
    equal.  Rows outside all bins get null.  The table is small by nature and is folded to one list
    for each exact key, so rows are never multiplied.
    """
    cols = [c for pair in inputs.values() for c in pair]
    bins = F.collect_list(F.struct(*cols, F.col(value).alias("value")))
    lists = table.groupBy(*exact).agg(bins.alias("__bins")) if exact else table.agg(bins.alias("__bins"))
    joined = df.join(lists, list(exact), "left") if exact else df.crossJoin(F.broadcast(lists))  # one row

    def holds(b: Column) -> Column:
        out = F.lit(True)
        for c, (lo, hi) in inputs.items():
            out = out & (b[lo] <= F.col(c)) & (F.col(c) < b[hi])
        return out

    return joined.withColumn(value, F.get(F.filter("__bins", holds), F.lit(0))["value"]).drop("__bins")
