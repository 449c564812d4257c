"""Relational joins with a recorded strategy.

The left side is the build side, the right one the probe side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOWS = ("inner", "left", "right", "outer")
STRATEGIES = ("auto", "broadcast", "shuffle", "sort", "salted")
#: A side larger than this by its statistics is never broadcast, whoever asks.
MOST_BROADCAST_BYTES = 256 << 20
#: Ranges of a key that one list holds.
MOST_RANGES = 4096


def size_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def choose_broadcast(build_bytes: int, probe_bytes: int, parts: int, broadcast: bool | None = None) -> bool:
    """Whether copying the build side to all parts moves less than shuffling both sides.

    Strict: equal costs shuffle.  A recorded choice is honoured.
    """
    if broadcast is not None:
        return broadcast
    return build_bytes * parts < build_bytes + probe_bytes


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", strategy: str = "auto", salt: int | None = None, parts: int | None = None) -> DataFrame:
    """An equi-join by column names; the keys of an outer join are coalesced, never null.

    ``auto`` leaves the choice to Catalyst and AQE unless ``parts`` is given: then the cost rule of
    choose_broadcast decides.  ``broadcast`` sends the build side, which Spark can do for inner and
    right joins; for left and outer ones it broadcasts the probe side where that is legal (left) and
    else falls back to a shuffle, with the same rows.  A side over MOST_BROADCAST_BYTES is shuffled.
    ``salted`` splits hot keys of the right side over ``salt`` copies of the left side's rows
    (inner and right joins).  Options that the strategy does not use are refused.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in HOWS:
        raise ValueError(f"how is one of {HOWS}, not {how!r}")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    if salt is not None and strategy != "salted":
        raise ValueError("salt only applies to the salted strategy")
    if parts is not None and strategy != "auto":
        raise ValueError("parts only applies to the auto strategy")
    if strategy == "auto" and parts is not None:
        strategy = "broadcast" if choose_broadcast(size_bytes(left), size_bytes(right), parts) else "shuffle"
    if strategy == "broadcast":
        small = right if how == "left" else left
        if how == "outer" or size_bytes(small) > MOST_BROADCAST_BYTES:
            return left.join(right, on, how)
        return left.join(F.broadcast(right), on, how) if how == "left" else F.broadcast(left).join(right, on, how)
    if strategy == "shuffle":
        return left.hint("shuffle_hash").join(right, on, how)
    if strategy == "sort":
        return left.hint("merge").join(right, on, how)
    if strategy == "salted":
        return _salted(left, right, on, how, salt or 8)
    return left.join(right, on, how)


def _salted(left: DataFrame, right: DataFrame, on: list[str], how: str, salt: int) -> DataFrame:
    if how not in ("inner", "right"):
        raise ValueError("a salted join is inner or right: the other side's rows are copied")
    if salt < 1:
        raise ValueError("salt is at least 1")
    rest = [c for c in right.columns if c not in on] or on
    spread = F.pmod(F.xxhash64(*rest), F.lit(salt)).cast("int")
    copied = left.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return copied.join(right.withColumn("__salt", spread), [*on, "__salt"], how).drop("__salt")


def range_semi_join(rows: DataFrame, ranges: DataFrame, key: str, value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows whose value lies in some closed range of their key.

    Ranges are merged where they touch, by a running maximum, so those of a key are disjoint; a row
    is then held against the one of them that starts last before it, found by binary search in the
    key's sorted starts.  A row meets one list and is never multiplied.  Keys with more ranges than
    MOST_RANGES are cut into runs of that many, each with the values that it can hold.
    """
    good = ranges.where(F.col(lo) <= F.col(hi)).select(F.col(key).alias("__k"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    order = Window.partitionBy("__k").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.sum(F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = good.withColumn("__n", opened).groupBy("__k", "__n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    run = F.floor((F.col("__n") - 1) / MOST_RANGES)
    lists = merged.groupBy("__k", run.alias("__run")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__ranges"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    here = (F.col(key) == F.col("__k")) & (F.col("__lo") <= F.col(value)) & (F.col(value) <= F.col("__hi"))
    # halving the steps: the last range that starts at or before the value
    steps = F.transform(F.sequence(F.lit(MOST_RANGES.bit_length() - 1), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    at = F.aggregate(steps, F.lit(0), lambda place, step: F.when(F.get(F.col("__ranges"), place + step)["lo"] <= F.col(value), place + step).otherwise(place))
    found = rows.join(lists, here)
    return found.where(F.get(F.col("__ranges"), at)["hi"] >= F.col(value)).select(*[rows[c] for c in rows.columns])


def broadcast_with_tail(build: DataFrame, probe: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join that keeps the build side broadcast: matches, then unmatched build rows once."""
    on = list(on)
    if size_bytes(build) > MOST_BROADCAST_BYTES:
        return build.join(probe, on, "left")
    matched = F.broadcast(build).join(probe, on, "inner")
    tail = build.join(probe.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(tail, allowMissingColumns=True)
