"""Histograms as long tables, any number of them filled in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Regular:
    """Equal bins over [lo, hi); bin 0 is below, bin ``bins``+1 above, with nan."""

    bins: int
    lo: float
    hi: float

    def __post_init__(self):
        if self.bins < 1 or not self.lo < self.hi:
            raise ValueError("an axis needs at least one bin and lo < hi")

    def index(self, x: Column) -> Column:
        """The bin of a value; null stays null."""
        x = x.cast("double")
        inner = F.floor((x - self.lo) / (self.hi - self.lo) * self.bins).cast("int") + 1
        return F.when(x.isNull(), None).when(F.isnan(x) | (x >= self.hi), self.bins + 1).when(x < self.lo, 0).otherwise(F.least(inner, F.lit(self.bins)))


@dataclass(frozen=True)
class Fill:
    """One histogram: a name, an axis, a value (a number or a list of them), and options.

    ``weight`` applies to all values of the row; ``where`` decides whether the row fills at all.
    """

    name: str
    axis: Regular
    value: Column
    weight: Column | None = None
    where: Column | None = None
    many: bool = False


def _entry(f: Fill):
    weight = (F.lit(1.0) if f.weight is None else f.weight).cast("double")
    return lambda x: F.struct(F.lit(f.name).alias("hist"), f.axis.index(x).alias("bin"), weight.alias("w"))


def fill(df: DataFrame, fills: Sequence[Fill], by: Sequence[str] = ()) -> DataFrame:
    """(*by, hist, bin, n, sumw, sumw2), bins with entries only, from one scan and one shuffle.

    Every row becomes a short list of (hist, bin, weight) entries; the exchange carries partial sums
    per bin, whatever the number of rows.  Null values fill nothing.
    """
    if len({f.name for f in fills}) != len(fills):
        raise ValueError("histogram names repeat")
    parts = []
    for f in fills:
        entry = _entry(f)
        one = F.transform(f.value, entry) if f.many else F.array(entry(f.value))
        empty = F.filter(one, lambda e: F.lit(False))
        parts.append(one if f.where is None else F.when(f.where, one).otherwise(empty))
    entries = F.flatten(F.array(*[F.coalesce(p, F.filter(p, lambda e: F.lit(False))) for p in parts])) if len(parts) > 1 else parts[0]
    rows = df.select(*by, F.explode(entries).alias("e")).select(*by, "e.*").where("bin is not null")
    return rows.groupBy(*by, "hist", "bin").agg(F.count("*").alias("n"), F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))


def dense(filled: DataFrame, axes: dict[str, Regular], by: Sequence[str] = ()) -> DataFrame:
    """All bins of each histogram, empty ones as zeros, under- and overflow included."""
    spark = filled.sparkSession
    grid = F.array(*[F.struct(F.lit(n).alias("hist"), F.sequence(F.lit(0), F.lit(a.bins + 1)).alias("bins")) for n, a in axes.items()])
    bins = spark.range(1).select(F.inline(grid)).select("hist", F.explode("bins").alias("bin"))
    if by:
        bins = filled.select(*by).distinct().crossJoin(F.broadcast(bins))  # the grid is bounded by the axes
    zero = lambda c: F.coalesce(c, F.lit(0))
    return bins.join(filled, [*by, "hist", "bin"], "left").select(*by, "hist", "bin", zero(F.col("n")).alias("n"), F.coalesce("sumw", F.lit(0.0)).alias("sumw"), F.coalesce("sumw2", F.lit(0.0)).alias("sumw2"))


def write_json(hists: DataFrame, path: str) -> None:
    """The long table as JSON lines."""
    hists.write.mode("overwrite").json(path)


def uhi(hists: DataFrame, axes: dict[str, Regular]) -> DataFrame:
    """(hist, json): each histogram as one document of the UHI layout, flow bins included."""
    rows = dense(hists.where(F.col("hist").isin(*axes)), axes)
    listed = rows.groupBy("hist").agg(F.array_sort(F.collect_list(F.struct("bin", "sumw", "sumw2"))).alias("b"))  # as long as the axis
    axis = F.create_map(*[x for n, a in axes.items() for x in (F.lit(n), F.struct(F.lit("regular").alias("type"), F.lit(float(a.lo)).alias("lower"), F.lit(float(a.hi)).alias("upper"), F.lit(a.bins).alias("bins"), F.lit(True).alias("underflow"), F.lit(True).alias("overflow"), F.lit(False).alias("circular")))])
    storage = F.struct(F.lit("weighted").alias("type"), F.transform("b", lambda x: x["sumw"]).alias("values"), F.transform("b", lambda x: x["sumw2"]).alias("variances"))
    return listed.select("hist", F.to_json(F.struct(F.lit(1).alias("uhi_schema"), F.col("hist").alias("name"), F.array(axis[F.col("hist")]).alias("axes"), storage.alias("storage"))).alias("json"))


def write_uhi(hists: DataFrame, axes: dict[str, Regular], path: str) -> None:
    """One UHI document a line."""
    uhi(hists, axes).select(F.col("json").alias("value")).write.mode("overwrite").text(path)
