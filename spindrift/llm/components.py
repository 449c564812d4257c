"""Distributed connected components by alternating large-star and small-star passes.

Only DataFrame operations are used.  Each pass is one aggregation and one join on the same key,
so a hub costs one aggregated row on the small side; the joined side can be split by AQE.  The
edge table is written to the shared folder after each round, so lost executors cost no more than
the round that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
    return both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("lo"))
    moved = e.join(least, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
    return moved.unionAll(least.select("u", F.col("lo").alias("v"))).distinct()


def _digest(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 32).cast("long"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node.

    Node values may be of any orderable type.  Edges with a null end and self-loops add nothing: a
    node that appears in no other edge is absent from the result.  An empty list gives no rows.
    Repeated and reversed edges are allowed.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = materialize(pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        following = materialize(_small_star(_large_star(now)), "edges")
        release(now)
        now, before, seen = following, seen, _digest(following)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
