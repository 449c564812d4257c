"""What the catalogue's queries share: events with nested objects, and SQL fragments for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hist import Regular
from ..sources.readers import read_table

Registry = dict[str, tuple]


def registered(registry: Registry, sql: str | None):
    """Enter a query under its function's name, with its oracle SQL if there is any."""

    def enter(fn):
        registry[fn.__name__] = (fn, sql)
        return fn

    return enter


def isum(x: Column, scale: int = 10_000) -> Column:
    """An exact sum: values as whole multiples of 1/scale."""
    return F.coalesce(F.sum(F.rint(x * float(scale)).cast("long")), F.lit(0).cast("long"))


def isum_sql(x: str, scale: int = 10_000) -> str:
    return f"CAST(coalesce(sum(CAST(round_even(({x}) * {float(scale)}::DOUBLE, 0) AS BIGINT)), 0) AS BIGINT)"


def bin_sql(x: str, axis: Regular) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({v}) OR {v} >= {axis.hi} THEN {axis.bins + 1} WHEN {v} < {axis.lo} THEN 0 ELSE least(CAST(floor(({v} - {axis.lo}::DOUBLE) / {axis.hi - axis.lo}::DOUBLE * {axis.bins}) AS INTEGER) + 1, {axis.bins}) END"


def hist_sql(name: str, axis: Regular, value: str, source: str, where: str = "TRUE") -> str:
    """(hist, bin, n) of a value over a FROM item."""
    return f"SELECT '{name}' AS hist, CAST(b AS INTEGER) AS bin, count(*) AS n FROM (SELECT {bin_sql(value, axis)} AS b FROM {source} WHERE {where}) WHERE b IS NOT NULL GROUP BY b"


#: Objects of an order, one row each, numbered by falling pt.
OBJ = """obj AS (
SELECT ev, pt, eta, phi, mass, flag, charge, CAST(row_number() OVER (PARTITION BY ev ORDER BY pt DESC, pk, sk, ln, flag, mass) AS INTEGER) AS rn
FROM (SELECT l_orderkey AS ev, l_extendedprice / 1000.0::DOUBLE AS pt, CAST(l_partkey % 500 AS DOUBLE) / 100.0::DOUBLE - 2.5::DOUBLE AS eta,
 CAST(l_suppkey % 628 AS DOUBLE) / 100.0::DOUBLE - 3.14::DOUBLE AS phi, l_quantity / 10.0::DOUBLE AS mass, l_returnflag AS flag,
 CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS charge, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln FROM lineitem))"""

#: The scalar part of an event.
MET = """met AS (SELECT o_orderkey AS ev, o_totalprice / 1000.0::DOUBLE AS met, CAST(o_custkey % 628 AS DOUBLE) / 100.0::DOUBLE - 3.14::DOUBLE AS met_phi FROM orders)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev and ``obj``, the order's lines as structs by falling pt: one shuffle, map-side nothing to combine."""
    d = read_table(spark, sf_dir, "lineitem")
    x = F.struct(
        (-(F.col("l_extendedprice") / 1000.0)).alias("k0"),
        F.col("l_partkey").alias("k1"),
        F.col("l_suppkey").alias("k2"),
        F.col("l_linenumber").alias("k3"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_quantity") / 10.0).alias("mass"),
        (F.col("l_extendedprice") / 1000.0).alias("pt"),
        ((F.col("l_partkey") % 500).cast("double") / 100.0 - 2.5).alias("eta"),
        ((F.col("l_suppkey") % 628).cast("double") / 100.0 - 3.14).alias("phi"),
        F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("charge"),
    )
    kept = lambda s: F.struct(*[s[n].alias(n) for n in ("pt", "eta", "phi", "mass", "flag", "charge")])
    return d.groupBy(F.col("l_orderkey").alias("ev")).agg(F.transform(F.array_sort(F.collect_list(x)), kept).alias("obj"))


def mets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ev"), (F.col("o_totalprice") / 1000.0).alias("met"), ((F.col("o_custkey") % 628).cast("double") / 100.0 - 3.14).alias("met_phi"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev, met, met_phi, obj of orders that have lines."""
    return mets(spark, sf_dir).join(objects(spark, sf_dir), "ev")


def rounded_sql(x: str) -> str:
    return f"(round_even(({x}) * 1e6::DOUBLE, 0) / 1e6::DOUBLE)"


def dphi_sql(a: str, b: str) -> str:
    d = f"({a} - {b} + pi())"
    return f"({d} - 2 * pi() * floor({d} / (2 * pi())) - pi())"


def mass_sql(*names: str) -> str:
    """Invariant mass of object aliases."""
    t = " + ".join(f"sqrt(pow({n}.pt * cosh({n}.eta), 2) + pow({n}.mass, 2))" for n in names)
    x, y, z = (" + ".join(f"{n}.pt * {f.format(n)}" for n in names) for f in ("cos({0}.phi)", "sin({0}.phi)", "sinh({0}.eta)"))
    return f"sqrt(greatest(pow({t}, 2) - pow({x}, 2) - pow({y}, 2) - pow({z}, 2), 0.0::DOUBLE))"


def pt_sql(*names: str) -> str:
    x, y = (" + ".join(f"{n}.pt * {f}({n}.phi)" for n in names) for f in ("cos", "sin"))
    return f"sqrt(pow({x}, 2) + pow({y}, 2))"
