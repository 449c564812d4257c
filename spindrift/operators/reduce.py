"""Reductions: a fixed combine tree for floats, counters, collation, failure budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_fold(df: DataFrame, leaf: str, value: str, by: Sequence[str] = (), combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(*by, value): leaf partials folded in the fixed tree (0,1),(2,3)..., an odd one carried up.

    ``df`` has one row for each leaf and group.  The grouping depends on leaf order alone, so float
    results do not depend on partitions or arrival.  One shuffle; a group's partials form one list,
    so a group should have no more than some 100,000 leaves: beyond that use tree_fold_levels.
    """
    combine = combine or (lambda a, b: a + b)
    rows = df.select(*by, F.struct(F.col(leaf).alias("leaf"), F.col(value).alias("v")).alias("s"))
    lists = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("leaves"))

    def halve(level: Column) -> Column:
        n = F.size(level)
        at = F.sequence(F.lit(0), F.ceil(n / 2).cast("int") - 1)
        pair = lambda i: F.when(2 * i + 1 < n, combine(F.get(level, 2 * i), F.get(level, 2 * i + 1))).otherwise(F.get(level, 2 * i))
        return F.transform(at, pair)

    depth = F.ceil(F.log2(F.greatest(F.size("leaves"), F.lit(1)).cast("double"))).cast("int")
    folded = F.aggregate(F.array_repeat(F.lit(0), depth), F.col("leaves"), lambda level, _: halve(level))
    return lists.select(*by, F.get(folded, F.lit(0)).alias(value))


def tree_fold_levels(df: DataFrame, leaf: str, value: str, by: Sequence[str] = (), leaves: int | None = None) -> DataFrame:
    """The same fold, one shuffle a level, for leaves too many for a list: pairs are summed by position.

    ``leaf`` must be dense from 0 in each group.
    """
    rows = df.select(*by, F.col(leaf).cast("long").alias("pos"), F.col(value).alias(value))
    n = leaves if leaves is not None else (rows.agg(F.max("pos")).first()[0] or 0) + 1
    while n > 1:
        pair = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).alias("v"))))
        rows = rows.groupBy(*by, F.expr("pos div 2").alias("half")).agg(pair.alias("p")).select(*by, F.col("half").alias("pos"), F.when(F.size("p") > 1, F.get("p", F.lit(0))["v"] + F.get("p", F.lit(1))["v"]).otherwise(F.get("p", F.lit(0))["v"]).alias(value))
        n = -(-n // 2)
    return rows.drop("pos")


def counters(weight: str | None = None) -> list[Column]:
    """nTot, nPos, nNeg, nEff and genWeightSum of a chunk; without weights each row weighs 1."""
    w = F.col(weight) if weight else F.lit(1.0)
    return [F.count("*").alias("nTot"), F.count_if(w > 0).alias("nPos"), F.count_if(w < 0).alias("nNeg"), (F.count_if(w > 0) - F.count_if(w < 0)).alias("nEff"), F.coalesce(F.sum(w.cast("double")), F.lit(0.0)).alias("genWeightSum")]


def collate(datasets: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Many datasets' results in one table with a ``dataset`` column."""
    out = None
    for key in sorted(datasets):
        part = datasets[key].withColumn(name, F.lit(key))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to collate")
    return out


def spend_failures(results: DataFrame, budget: int, error: str = "error") -> tuple[DataFrame, int]:
    """Rows without an error, and how many had one; raises when there are more than ``budget``.

    ``results`` has one row for each chunk and a nullable ``error``.  Failed chunks are dead letters:
    they add nothing to the result.
    """
    if budget < 0:
        raise ValueError("a budget is at least 0")
    failed = results.where(F.col(error).isNotNull())
    n = failed.count()
    if n > budget:
        raise RuntimeError(f"{n} chunks failed, {budget} may: {failed.select(error).first()[0]}")
    return results.where(F.col(error).isNull()), n


def finalize(df: DataFrame, step: Callable):
    """A driver-side step over a reduced result."""
    return step(df.collect())
