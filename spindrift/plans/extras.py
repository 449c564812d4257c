"""Native additions beyond the event-analysis workload: not parity, just what Spark offers anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import read_table
from ..streaming import windows
from .base import Registry, isum, isum_sql, registered

REGISTRY: Registry = {}


@registered(REGISTRY, f"SELECT l_returnflag, l_linestatus, count(*) AS n, {isum_sql('l_quantity')} AS q_e4 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), isum(F.col("l_quantity")).alias("q_e4"))


@registered(REGISTRY, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@registered(REGISTRY, "SELECT o_orderkey, o_custkey, CAST(rk AS INTEGER) AS rk FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("rk")).where("rk <= 3")


@registered(REGISTRY, "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.intersect(read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@registered(REGISTRY, "SELECT p_brand AS b FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 48")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("b")).distinct().subtract(p.where("p_size > 48").select("p_brand"))


@registered(REGISTRY, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@registered(REGISTRY, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.col("ts"), "user_id", "event_type", "value", "props")


@registered(REGISTRY, "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf_dir), "ts", "1 hour", "event_type").select(F.col("w.start").alias("start"), "event_type", "n")


@registered(REGISTRY, "SELECT time_bucket(INTERVAL '30 minutes', ts) - s.d AS start, count(*) AS n FROM events, (VALUES (INTERVAL '0 minutes'), (INTERVAL '30 minutes')) s(d) GROUP BY 1")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(_events(spark, sf_dir), "ts", "1 hour", "30 minutes").select(F.col("w.start").alias("start"), "n")


@registered(REGISTRY, "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '1 hour' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(_events(spark, sf_dir), "ts", "1 hour", "user_id").select("user_id", F.col("w.start").alias("start"), "n")


@registered(REGISTRY, "SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) AS k, upper(event_type) AS kind, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hr, CAST(length(event_type) AS INTEGER) AS len FROM events")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.upper("event_type").alias("kind"), F.to_date("ts").alias("day"), F.hour("ts").alias("hr"), F.length("event_type").alias("len"))


@registered(REGISTRY, None)
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
