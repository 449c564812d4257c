"""Joins, exchange, reductions, user code and control over the relational tables."""

from __future__ import annotations

import json
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exchange as X
from ..operators import join as J
from ..operators.externals import External, binned_lookup, combine_leaves, map_leaves
from ..operators.reduce import spend_failures, tree_fold, tree_fold_levels
from ..sources.readers import read_table, step_of, with_leaf
from ..sources.sinks import PartialStore, parts_and_totals, shared_path, write_parts
from . import control
from .base import Registry, isum, isum_sql, registered

REGISTRY: Registry = {}


@registered(REGISTRY, "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return J.join(d, read_table(spark, sf_dir, "labels"), ["doc_id"])


@registered(REGISTRY, "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return J.join(d, read_table(spark, sf_dir, "labels"), ["doc_id"], "left")


_RICH = "SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 5000"
_DEAR = "SELECT o_custkey AS k, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000"


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), "c_acctbal")


def _dear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")


@registered(REGISTRY, f"SELECT k, c_acctbal, o_orderkey, o_totalprice FROM ({_RICH}) RIGHT JOIN ({_DEAR}) USING (k)")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join(_rich(spark, sf_dir), _dear(spark, sf_dir), ["k"], "right")


@registered(REGISTRY, f"SELECT k, c_acctbal, o_orderkey, o_totalprice FROM ({_RICH}) FULL JOIN ({_DEAR}) USING (k)")
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join(_rich(spark, sf_dir), _dear(spark, sf_dir), ["k"], "outer")


@registered(REGISTRY, f"SELECT k, c_acctbal, o_orderkey, o_totalprice FROM ({_RICH}) JOIN ({_DEAR}) USING (k)")
def join_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join(_rich(spark, sf_dir), _dear(spark, sf_dir), ["k"], strategy="shuffle")


@registered(REGISTRY, "SELECT n_nationkey AS k, n_name, s_suppkey, s_acctbal FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def join_broadcast_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.join(n, read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal"), ["k"], strategy="broadcast")


@registered(REGISTRY, "SELECT n_nationkey AS k, n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 7000) ON n_nationkey = s_nationkey")
def join_broadcast_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.broadcast_with_tail(n, read_table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select(F.col("s_nationkey").alias("k"), "s_suppkey"), ["k"])


@registered(REGISTRY, "SELECT n_nationkey AS k, n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
def join_cost_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.join(n, read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), ["k"], parts=8)


@registered(REGISTRY, f"SELECT a.l_returnflag AS flag, count(*) AS n, {isum_sql('a.l_quantity + b.l_tax')} AS s_e4 FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND b.l_returnflag = 'R' GROUP BY a.l_returnflag")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "lineitem")
    a = d.select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), "l_quantity")
    b = d.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_tax")
    return J.join(a, b, ["l_partkey", "l_suppkey"]).groupBy("flag").agg(F.count("*").alias("n"), isum(F.col("l_quantity") + F.col("l_tax")).alias("s_e4"))


@registered(REGISTRY, "SELECT a.c_nationkey AS nation, count(*) AS n FROM customer a, customer b GROUP BY a.c_nationkey")
def join_dup_skew_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers on one key, the most skewed join there is: both sides are counted by key first, so no pair is made."""
    c = read_table(spark, sf_dir, "customer")
    left = c.select(F.lit(7).alias("k"), F.col("c_nationkey").alias("nation")).groupBy("k", "nation").agg(F.count("*").alias("here"))
    right = c.select(F.lit(7).alias("k")).groupBy("k").agg(F.count("*").alias("there"))
    return J.join(left, right, ["k"]).groupBy("nation").agg(F.sum(F.col("here") * F.col("there")).alias("n"))


@registered(REGISTRY, f"SELECT c_mktsegment AS segment, count(*) AS n, {isum_sql('o_totalprice', 100)} AS price_e2 FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    return J.join(c, o, ["k"], strategy="salted", salt=4).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), isum(F.col("o_totalprice"), 100).alias("price_e2"))


@registered(REGISTRY, "SELECT r_regionkey AS k, CAST(NULL AS VARCHAR) AS n_name, r_name FROM region")
def join_empty_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = read_table(spark, sf_dir, "nation").where(F.lit(False)).select(F.col("n_regionkey").alias("k"), "n_name")
    return J.join(none, read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name"), ["k"], "right")


@registered(REGISTRY, f"SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, {isum_sql('l_extendedprice * (1 - l_discount)')} AS revenue_e4 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 10 GROUP BY 1, 2")
def join_then_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged plan: expressions before the joins, two joins, and a fold."""
    li = read_table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    od = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("status"))
    cu = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("segment"))
    wide = J.join(J.join(li, od, ["o"]), cu, ["c"])
    return wide.groupBy("segment", "status").agg(F.count("*").alias("n"), isum(F.col("rev")).alias("revenue_e4"))


_RANGES = "SELECT user_id, min(event_id) AS lo, min(event_id) + (user_id % 7) * 300 AS hi FROM events GROUP BY user_id UNION ALL SELECT user_id, max(event_id) - (user_id % 5) * 100, max(event_id) FROM events GROUP BY user_id"


@registered(REGISTRY, f"SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE EXISTS (SELECT 1 FROM ({_RANGES}) r WHERE r.user_id = e.user_id AND e.event_id BETWEEN r.lo AND r.hi)")
def range_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    ends = e.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z"))
    first = F.struct(F.col("a").alias("lo"), (F.col("a") + F.col("user_id") % 7 * 300).alias("hi"))
    last = F.struct((F.col("z") - F.col("user_id") % 5 * 100).alias("lo"), F.col("z").alias("hi"))
    ranges = ends.select("user_id", F.inline(F.array(first, last)))
    return J.range_semi_join(e, ranges, "user_id", "event_id").select("event_id", "user_id", "event_type")


def _route_sql(key: str, parts: int) -> str:
    return f"CAST(('0x' || substr(sha256(from_hex(lpad(hex({key}), 16, '0'))), 1, 16))::UBIGINT % {parts} AS INTEGER)"


@registered(REGISTRY, f"SELECT o_orderkey, {_route_sql('o_orderkey', 16)} AS dest16, {_route_sql('o_custkey', 1000)} AS dest1000 FROM orders")
def route_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.route(F.col("o_orderkey"), 16).alias("dest16"), X.route(F.col("o_custkey"), 1000).alias("dest1000"))


@registered(REGISTRY, f"SELECT dest, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, {_route_sql('o_orderkey', 8)} AS dest FROM orders) GROUP BY dest")
def repartition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = X.repartition_by_key(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8, ["o_orderkey"])
    return placed.groupBy("dest").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@registered(
    REGISTRY,
    f"""SELECT dest, count(*) AS rows, sha256(string_agg(sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}'), '' ORDER BY o_orderkey)) AS digest
 FROM (SELECT o_orderkey, o_orderstatus, {_route_sql("o_orderkey", 64)} AS dest FROM orders) GROUP BY dest""",
)
def partition_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = X.repartition_by_key(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 64, ["o_orderkey"])
    return X.fingerprint(placed, "dest", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@registered(REGISTRY, "SELECT doc_id, CAST(floor((upto - n_chars) / 50000) AS BIGINT) AS bucket FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents)")
def rebalance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return X.rebalance_by_size(d, ["doc_id"], F.col("n_chars"), 50_000).select("doc_id", "bucket")


@registered(REGISTRY, "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 13 < 8 THEN floor(o_orderkey % 13 / 2) ELSE 4 + floor((o_orderkey % 13 - 8) / 1) END AS INTEGER) AS producer FROM orders")
def producer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 source blocks over 9 producers: four take two, five take one."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.producers(F.col("o_orderkey") % 13, 13, 9).alias("producer"))


_LEAVES = "SELECT l_returnflag AS flag, l_orderkey // 250 AS leaf, CAST(sum(CAST(round_even(l_extendedprice * 100.0::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / 7.0::DOUBLE AS v FROM lineitem GROUP BY 1, 2"


def _tree_sql(levels: int = 20) -> str:
    ctes = [f"t0 AS (SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY leaf) - 1 AS pos, v FROM ({_LEAVES}))"]
    ctes += [f"t{i + 1} AS (SELECT flag, pos // 2 AS pos, CASE WHEN count(*) > 1 THEN max(CASE WHEN pos % 2 = 0 THEN v END) + max(CASE WHEN pos % 2 = 1 THEN v END) ELSE max(v) END AS v FROM t{i} GROUP BY flag, pos // 2)" for i in range(levels)]
    return f"WITH {', '.join(ctes)} SELECT flag, v FROM t{levels}"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_leaf(read_table(spark, sf_dir, "lineitem"), "l_orderkey", 250, "leaf")
    return d.groupBy(F.col("l_returnflag").alias("flag"), "leaf").agg((F.sum(F.rint(F.col("l_extendedprice") * 100.0).cast("long")).cast("double") / 7.0).alias("v"))


@registered(REGISTRY, _tree_sql())
def tree_fold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_fold(_leaves(spark, sf_dir), "leaf", "v", ["flag"])


@registered(REGISTRY, _tree_sql())
def tree_fold_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    dense = _leaves(spark, sf_dir).withColumn("leaf", F.row_number().over(Window.partitionBy("flag").orderBy("leaf")) - 1)
    return tree_fold_levels(dense, "leaf", "v", ["flag"])


@registered(REGISTRY, f"SELECT l_returnflag AS dataset, l_linenumber AS part, count(*) AS n, {isum_sql('l_quantity')} AS q_e4 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)")
def parts_and_totals_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("part"), "l_quantity")
    return parts_and_totals(d, "dataset", "part", [F.count("*").alias("n"), isum(F.col("l_quantity")).alias("q_e4")])


@registered(REGISTRY, f"SELECT l_returnflag AS dataset, CAST(l_orderkey // 2000 AS BIGINT) AS leaf_id, count(*) AS rows, {isum_sql('l_quantity')} AS q_e4 FROM lineitem GROUP BY 1, 2")
def part_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written by dataset and leaf, with each part's own sums as its sidecar."""
    d = with_leaf(read_table(spark, sf_dir, "lineitem"), "l_orderkey", 2000).withColumnRenamed("l_returnflag", "dataset")
    d = d.select("dataset", "leaf_id", "l_orderkey", "l_quantity").repartition("dataset", "leaf_id")
    summary = write_parts(d, shared_path(spark, "parts"), ["dataset", "leaf_id"], [isum(F.col("l_quantity")).alias("q_e4")])
    return summary.select("dataset", "leaf_id", "rows", "q_e4")


@registered(REGISTRY, f"SELECT l_orderkey // 500 AS leaf, {isum_sql('l_quantity')} AS q_e4 FROM lineitem GROUP BY 1")
def resumed_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops after a third of its leaves and is resumed from the stored partials."""
    d = with_leaf(read_table(spark, sf_dir, "lineitem"), "l_orderkey", 500, "leaf")
    leaves, schema = d.select("leaf").distinct(), "leaf long, q_e4 long"
    store = PartialStore(spark, shared_path(spark, "store"), "quantity by leaf of 500 orders")
    process = lambda todo: d.join(todo, "leaf", "left_semi").groupBy("leaf").agg(isum(F.col("l_quantity")).alias("q_e4"))
    store.add(process(leaves.where("leaf % 3 = 0")))
    store.add(process(store.missing(leaves, schema)))
    return store.load(schema)


def _read_props(group: pa.Table) -> int:
    """The sum of k over the leaf's records; leaves that hold a ``k`` of 13 fail, on purpose."""
    total = 0
    for text in group.column("props").drop_null().to_pylist():
        k = json.loads(text).get("k")
        if k == 13:
            raise ValueError("unlucky record")
        total += k or 0
    return total


@registered(REGISTRY, "SELECT CAST(sum(CAST(props::JSON->>'k' AS BIGINT)) AS BIGINT) AS total, (SELECT count(*) FROM (SELECT event_id // 20 FROM events GROUP BY 1 HAVING bool_or(CAST(props::JSON->>'k' AS INTEGER) = 13))) AS failed FROM events WHERE event_id // 20 NOT IN (SELECT event_id // 20 FROM events WHERE CAST(props::JSON->>'k' AS INTEGER) = 13)")
def failure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("leaf"), "props")
    results = map_leaves(e, "leaf", _read_props, catch=True).persist()
    # the leaves that fail on purpose may, counted apart from the user code; one failure more is too many
    unlucky = e.where(F.expr("try_cast(get_json_object(props, '$.k') AS double) = 13"))
    good, failed = spend_failures(results, unlucky.select("leaf").distinct().count())
    total = combine_leaves(good, lambda a, b: a + b, lambda: None)
    results.unpersist()
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(failed).cast("long").alias("failed"))


_BINS = [(q, d, 10.0 * q + d) for q in range(5) for d in range(3)]


@registered(
    REGISTRY,
    "WITH b(qlo, qhi, dlo, dhi, factor) AS (VALUES " + ", ".join(f"({10.0 * q}, {10.0 * q + 10}, {0.03 * d:.2f}, {0.03 * d + 0.03:.2f}, {f})" for q, d, f in _BINS) + ") SELECT l_orderkey, l_linenumber, l_quantity, CAST(factor AS DOUBLE) AS factor FROM lineitem LEFT JOIN b ON l_quantity >= CAST(qlo AS DOUBLE) AND l_quantity < CAST(qhi AS DOUBLE) AND l_discount >= CAST(dlo AS DOUBLE) AND l_discount < CAST(dhi AS DOUBLE)",
)
def correction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(F.lit(10.0 * q).alias("qlo"), F.lit(10.0 * q + 10).alias("qhi"), F.lit(float(f"{0.03 * d:.2f}")).alias("dlo"), F.lit(float(f"{0.03 * d + 0.03:.2f}")).alias("dhi"), F.lit(f).alias("factor")) for q, d, f in _BINS]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    got = binned_lookup(read_table(spark, sf_dir, "lineitem"), table, {"l_quantity": ("qlo", "qhi"), "l_discount": ("dlo", "dhi")}, "factor")
    return got.select("l_orderkey", "l_linenumber", "l_quantity", "factor")


def _scale(resource: dict, table: pa.Table) -> pa.Table:
    keys, values = table.column("p_partkey"), table.column("p_size").to_pylist()
    return pa.table({"p_partkey": keys, "scaled": pa.array([v * resource["scale"] + resource["offset"] for v in values], pa.int64())})


@registered(REGISTRY, "SELECT p_partkey, CAST(p_size * 3 + 5 AS BIGINT) AS scaled FROM part")
def external_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = External("scale", pickle.dumps({"scale": 3, "offset": 5}), pickle.loads, _scale, "p_partkey long, scaled long")
    return ext.apply(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"))


@registered(REGISTRY, "SELECT leaf_id, n_entries FROM (SELECT l_orderkey // 100 AS leaf_id, count(*) AS n_entries, coalesce(sum(count(*)) OVER (ORDER BY l_orderkey // 100 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem GROUP BY 1) WHERE before < 5000")
def stop_at_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = with_leaf(read_table(spark, sf_dir, "lineitem"), "l_orderkey", 100).groupBy("leaf_id").agg(F.count("*").alias("n_entries"))
    return control.stop_at_target(leaves, 5000).select("leaf_id", "n_entries")


@registered(REGISTRY, f"SELECT count(*) AS entries, {isum_sql('l_quantity')} AS q_e4 FROM lineitem")
def adaptive_pull_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of order ranges, each a job with a pushed-down key filter; wave sizes double."""
    d = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    top = d.agg(F.max("l_orderkey")).first()[0]
    state = {"at": 0, "width": max(1, (top or 0) // 8)}

    def ask(progress: control.Progress) -> list | None:
        if top is None or state["at"] > top:
            return None
        lo, hi = state["at"], state["at"] + state["width"]
        state.update(at=hi, width=state["width"] * 2)
        return [(lo, hi)]

    def process(leaves: list) -> tuple[tuple, int]:
        (lo, hi) = leaves[0]
        n, q = d.where((F.col("l_orderkey") >= lo) & (F.col("l_orderkey") < hi)).agg(F.count("*"), isum(F.col("l_quantity"))).first()
        return (n, q), n

    got = control.pull(ask, process, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda: (0, 0))
    return spark.range(1).select(F.lit(got.value[0]).cast("long").alias("entries"), F.lit(got.value[1]).cast("long").alias("q_e4"))


@registered(REGISTRY, "SELECT CAST(CASE WHEN r < 9 * 4 THEN r // 4 ELSE 9 + (r - 36) // 3 END AS INTEGER) AS step, count(*) AS n FROM (SELECT range AS r FROM range(0, 48)) GROUP BY 1")
def entry_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 rows in 13 steps: nine of four rows and four of three."""
    return spark.range(48).groupBy(step_of(F.col("id"), 48, 13).alias("step")).agg(F.count("*").alias("n"))
