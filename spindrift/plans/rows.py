"""Queries for single rows of the survey: sources, sinks, records, flags, user code and run control."""

from __future__ import annotations

import json
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kinematics as K
from ..operators import exchange as X
from ..operators.externals import combine_leaves, map_leaves
from ..operators.hist import Fill, Regular, fill, write_uhi
from ..operators.join import range_semi_join
from ..operators.reduce import finalize
from ..sources.readers import from_memory, read_table, register_source, step_of, warn_few_tasks
from ..sources.sinks import shared_path, write_parts, write_result
from ..streaming.windows import dedup
from . import control
from .base import MET, OBJ, Registry, dphi_sql, events, hist_sql, isum, isum_sql, objects, registered, rounded_sql

REGISTRY: Registry = {}


# ---- sources and sinks --------------------------------------------------------------------------


@registered(REGISTRY, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the table of regions, a handful of rows, held in memory."""
    regions = from_memory(spark, read_table(spark, sf_dir, "region").select("r_regionkey", "r_name").toArrow())
    n = read_table(spark, sf_dir, "nation")
    return n.join(regions, n.n_regionkey == regions.r_regionkey).select("n_nationkey", "n_name", "r_name")


def _slots(spec: int, options: dict):
    first = spec * 8
    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + 8), pa.int64()), pa.array([spec] * 8, pa.int32())], names=["slot", "part"])


@registered(REGISTRY, "SELECT o_orderkey % 64 AS slot, CAST(o_orderkey % 64 // 8 AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1, 2")
def partitioned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of eight partitions, each read in a task."""
    register_source(spark, "spindrift_slots", "slot long, part int", lambda options: list(range(8)), _slots)
    slots = spark.read.format("spindrift_slots").load()
    orders = read_table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 64).alias("slot")).agg(F.count("*").alias("n"))
    return slots.join(orders, "slot").select("slot", "part", "n")


@registered(REGISTRY, "SELECT CAST(CASE WHEN r < k.more * (k.small + 1) THEN r // (k.small + 1) ELSE k.more + (r - k.more * (k.small + 1)) // k.small END AS INTEGER) AS step, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), (SELECT count(*) // 13 AS small, count(*) % 13 AS more FROM orders) k GROUP BY 1")
def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in 13 contiguous steps whose sizes differ by one at most."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    numbered = X.rebalance_by_size(o, ["o_orderkey"], F.lit(1), 1, "row")
    return numbered.groupBy(step_of(F.col("row"), o.count(), 13).alias("step")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@registered(REGISTRY, "SELECT TRUE AS few")
def few_tasks_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan put in one task is too few wherever there are several cores."""
    return spark.range(1).select(F.lit(warn_few_tasks(read_table(spark, sf_dir, "nation").coalesce(1))).alias("few"))


_PRICE = Regular(40, 0.0, 120.0)


@registered(REGISTRY, f"SELECT hist, bin, n FROM ({hist_sql('price', _PRICE, 'l_extendedprice / 1000.0::DOUBLE', 'lineitem')}) WHERE n > 0")
def uhi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram written in the UHI layout and read back."""
    filled = fill(read_table(spark, sf_dir, "lineitem"), [Fill("price", _PRICE, F.col("l_extendedprice") / 1000.0)])
    path = shared_path(spark, "uhi")
    write_uhi(filled, {"price": _PRICE}, path)
    document = F.from_json("value", "name string, storage struct<values: array<double>>")
    read = spark.read.text(path).select(document.alias("d")).select(F.col("d.name").alias("hist"), F.posexplode("d.storage.values").alias("bin", "n"))
    return read.where("n > 0").select("hist", "bin", F.col("n").cast("long").alias("n"))


@registered(REGISTRY, f"SELECT o_orderstatus AS status, count(*) AS n, {isum_sql('o_totalprice', 100)} AS price_e2 FROM orders GROUP BY 1")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as a table and read back."""
    o = read_table(spark, sf_dir, "orders")
    return write_result(o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), isum(F.col("o_totalprice"), 100).alias("price_e2")), shared_path(spark, "result"))


@registered(REGISTRY, f"SELECT f AS flag, CAST(s AS INTEGER) AS line, coalesce(n, 0) AS rows, coalesce(q, 0) AS q_e4 FROM (VALUES ('A'), ('N'), ('R'), ('Z')) a(f), range(1, 9) b(s) LEFT JOIN (SELECT l_returnflag, l_linenumber, count(*) AS n, {isum_sql('l_quantity')} AS q FROM lineitem GROUP BY 1, 2) ON l_returnflag = f AND l_linenumber = s")
def empty_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that must be there, some of them without a row."""
    d = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("int").alias("line"), "l_quantity")
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, "ANRZ"))).alias("flag")).select("flag", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("line"))
    return write_parts(d, shared_path(spark, "parts"), ["flag", "line"], [isum(F.col("l_quantity")).alias("q_e4")], wanted).select("flag", "line", "rows", "q_e4")


# ---- records and flags --------------------------------------------------------------------------


@registered(REGISTRY, "SELECT l_orderkey, l_linenumber, l_quantity > 10 AND l_discount > 0.02::DOUBLE AND l_tax < 0.06::DOUBLE AS passed, l_quantity > 10 OR l_discount > 0.02::DOUBLE OR l_tax < 0.06::DOUBLE AS touched FROM lineitem")
def flag_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: all columns of one prefix, reduced by and and by or."""
    d = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("cut_q"), (F.col("l_discount") > 0.02).alias("cut_d"), (F.col("l_tax") < 0.06).alias("cut_t"), F.lit("no flag").alias("cut_name"))
    return d.select("l_orderkey", "l_linenumber", A.flags(d, "cut_").alias("passed"), A.flags(d, "cut_", "or").alias("touched"))


@registered(REGISTRY, "SELECT l_orderkey, l_linenumber, CAST((l_partkey & 12) >> 2 AS BIGINT) AS quality, (l_partkey & (1 << 5)) <> 0 AS tight, CAST(xor(l_partkey, l_suppkey) AS BIGINT) AS mixed, CAST(l_partkey | 1024 AS BIGINT) AS marked, CAST(bit_count(l_partkey) AS INTEGER) AS ones FROM lineitem")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit fields of a word: masks, shifts and single flags."""
    d, p = read_table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("long")
    return d.select("l_orderkey", "l_linenumber", A.bit_field(p, 2, 2).alias("quality"), A.bit_set(p, 5).alias("tight"), p.bitwiseXOR(F.col("l_suppkey").cast("long")).alias("mixed"), p.bitwiseOR(F.lit(1024)).alias("marked"), F.bit_count(p).alias("ones"))


@registered(REGISTRY, f"WITH {OBJ} SELECT ev, CAST(count(*) AS INTEGER) AS n, {isum_sql('pt * pt')} AS squares_e4, CAST(sum(rn - 1) AS BIGINT) AS places, CAST(sum(CASE WHEN charge > 0 THEN 7 ELSE 0 END) AS BIGINT) AS sevens FROM obj GROUP BY ev")
def built_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one event zipped to records, with a constant beside them."""
    d = objects(spark, sf_dir)
    pt = F.transform("obj", lambda o: o["pt"])
    rec = A.zipped(pt=pt, at=A.local_index(F.col("obj")), charge=F.transform("obj", lambda o: o["charge"]), seven=A.full_like(F.col("obj"), 7))
    whole = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    squares = F.transform("rec", lambda r: F.rint(r["pt"] * r["pt"] * 10_000.0))
    return d.select("ev", rec.alias("rec")).select("ev", F.size("rec").alias("n"), whole(squares).alias("squares_e4"), whole(F.transform("rec", lambda r: r["at"])).alias("places"), whole(F.transform(F.filter("rec", lambda r: r["charge"] > 0), lambda r: r["seven"])).alias("sevens"))


@registered(REGISTRY, f"WITH {OBJ}, {MET} SELECT obj.ev, charge AS lead_charge, eta AS lead_eta, flag AS lead_flag, mass AS lead_mass, phi AS lead_phi, pt AS lead_pt, met AS sum_met, met_phi AS sum_phi FROM obj JOIN met USING (ev) WHERE rn = 1")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Struct columns listed and flattened with a prefix each; functions take any such struct."""
    d = events(spark, sf_dir).select("ev", A.first(F.col("obj")).alias("lead"), F.struct(F.col("met"), F.col("met_phi").alias("phi")).alias("sum"))
    return d.select("ev", *A.flattened(d, {"lead": "lead_", "sum": "sum_"}))


@registered(REGISTRY, f"WITH {OBJ} SELECT a.ev, CAST(count(*) AS BIGINT) AS pairs, {isum_sql('a.pt * b.pt')} AS products_e4 FROM obj a JOIN obj b ON a.ev = b.ev AND a.charge > 0 AND b.charge < 0 GROUP BY a.ev")
def nested_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each object of one charge the list of those of the other."""
    of = lambda sign: F.filter("obj", lambda o: o["charge"] * sign > 0)
    nested = objects(spark, sf_dir).select("ev", A.cross(of(1), of(-1)).alias("x"))
    flat = nested.select("ev", F.explode("x").alias("row")).select("ev", F.explode("row").alias("p"))
    return flat.groupBy("ev").agg(F.count("*").alias("pairs"), isum(F.col("p.a.pt") * F.col("p.b.pt")).alias("products_e4"))


@registered(REGISTRY, f"WITH {OBJ} SELECT a.ev, a.rn - 1 AS i, b.rn - 1 AS j, {rounded_sql(f'sqrt(pow(a.eta - b.eta, 2) + pow({dphi_sql('a.phi', 'b.phi')}, 2))')} AS dr FROM obj a JOIN obj b ON a.ev = b.ev AND a.flag = 'R' AND b.flag = 'A'")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of distances between two lists of an event."""
    with_place = F.transform("obj", lambda o, i: o.withField("i", i))
    d = objects(spark, sf_dir).select("ev", with_place.alias("o"))
    of = lambda flag: F.filter("o", lambda x: x["flag"] == flag)
    table = F.transform(A.cross(of("R"), of("A")), lambda row: F.transform(row, lambda p: F.struct(p["a"]["i"].alias("i"), p["b"]["i"].alias("j"), K.rint_to(K.delta_r(p["a"]["eta"], p["a"]["phi"], p["b"]["eta"], p["b"]["phi"])).alias("dr"))))
    return d.select("ev", F.explode(F.flatten(table)).alias("t")).select("ev", "t.i", "t.j", "t.dr")


@registered(REGISTRY, "SELECT CAST(0 AS INTEGER) AS src_pid, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 1, c_nationkey, count(*) FROM customer GROUP BY 2")
def union_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks behind each other, each with its ordinal."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return X.union_blocks(s, c).groupBy("src_pid", "k").agg(F.count("*").alias("n"))


_WIDE = "SELECT user_id, event_id - 3 AS lo, event_id + 40 AS hi FROM events WHERE event_id % 7 = 0 UNION ALL SELECT user_id, event_id, event_id - 1 FROM events WHERE event_id % 11 = 0 UNION ALL SELECT user_id, event_id, event_id + 400 FROM events WHERE event_id % 97 = 0"


@registered(REGISTRY, f"SELECT e.event_id, e.user_id FROM events e WHERE EXISTS (SELECT 1 FROM ({_WIDE}) r WHERE r.user_id = e.user_id AND e.event_id BETWEEN r.lo AND r.hi)")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that overlap, nest, touch or are empty."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    r = lambda every, lo, hi: e.where(F.col("event_id") % every == 0).select("user_id", (F.col("event_id") + lo).alias("lo"), (F.col("event_id") + hi).alias("hi"))
    return range_semi_join(e, r(7, -3, 40).unionAll(r(11, 0, -1)).unionAll(r(97, 0, 400)), "user_id", "event_id")


# ---- user code and run control ------------------------------------------------------------------


@registered(REGISTRY, "SELECT CAST(-1 AS BIGINT) AS none, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def empty_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No leaves give the identity, leaves their fold."""
    d = read_table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("leaf"), "l_linenumber")
    leaves = map_leaves(d, "leaf", lambda t: sum(t.column("l_linenumber").to_pylist())).select("leaf", "value")
    fold = lambda x: combine_leaves(x, lambda a, b: a + b, lambda: -1)
    return spark.range(1).select(F.lit(fold(leaves.where("false"))).cast("long").alias("none"), F.lit(fold(leaves)).cast("long").alias("total"))


@registered(REGISTRY, "SELECT count(DISTINCT o_custkey) AS customers, CAST(max(n) AS BIGINT) AS most FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def finalized_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A driver-side step over a reduced result of a few rows."""
    o = read_table(spark, sf_dir, "orders")
    customers = o.agg(F.count_distinct("o_custkey")).first()[0]
    most = finalize(o.groupBy("o_orderstatus").count(), lambda rows: max(r["count"] for r in rows))
    return spark.range(1).select(F.lit(customers).cast("long").alias("customers"), F.lit(most).cast("long").alias("most"))


@registered(REGISTRY, "SELECT event_id // 50 AS leaf, CAST(sum(CAST(props::JSON->>'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def retried_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code that fails on its first try in each leaf and passes on the second."""
    e = read_table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("leaf"), "props")

    def process(group: pa.Table, tried: set = set()) -> int:  # noqa: B006
        first = group.column("props")[0].as_py(), group.num_rows
        if first not in tried:
            tried.add(first)
            raise OSError("not yet")
        return sum(json.loads(t)["k"] for t in group.column("props").to_pylist())

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pickle.loads(v.as_py()) for v in batch.column(1)], pa.int64())], names=["leaf", "total"])

    return map_leaves(e, "leaf", process, retries=1).select("leaf", "value").mapInArrow(read, "leaf long, total long")


def _waves(spark: SparkSession, sf_dir: str):
    d = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    top = d.agg(F.max("l_orderkey")).first()[0] or 0
    width = top // 10 + 1
    starts = list(range(0, top + 1, width))

    def process(leaves: list) -> tuple[int, int]:
        lo = leaves[0]
        total, n = d.where((F.col("l_orderkey") >= lo) & (F.col("l_orderkey") < lo + width)).agg(F.coalesce(F.sum("l_linenumber"), F.lit(0)), F.count("*")).first()
        return total, n

    return starts, process


_TENTH = "(SELECT max(l_orderkey) // 10 + 1 AS w FROM lineitem)"


@registered(REGISTRY, f"SELECT 'entries' AS stopped, CAST(sum(n) AS BIGINT) AS n, CAST(sum(t) AS BIGINT) AS total FROM (SELECT l_orderkey // w AS wave, count(*) AS n, sum(l_linenumber) AS t, coalesce(sum(count(*)) OVER (ORDER BY l_orderkey // w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem, {_TENTH} GROUP BY 1) WHERE before < 1000")
def stopped_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of order ranges until a thousand rows are in."""
    starts, process = _waves(spark, sf_dir)
    left, seen = list(starts), []
    got = control.pull(lambda p: [left.pop(0)] if left else None, lambda w: seen.append(process(w)) or seen[-1], lambda a, b: a + b, lambda: 0, control.Stop(entries=1000))
    return spark.range(1).select(F.lit(got.stopped).alias("stopped"), F.lit(sum(n for _, n in seen)).cast("long").alias("n"), F.lit(got.value).cast("long").alias("total"))


@registered(REGISTRY, f"SELECT 'cancelled' AS stopped, string_agg(t, ',' ORDER BY wave) AS totals FROM (SELECT l_orderkey // w AS wave, CAST(sum(l_linenumber) AS VARCHAR) AS t FROM lineitem, {_TENTH} WHERE l_orderkey // w IN (7, 8, 9) GROUP BY 1)")
def cancelled_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves asked for from the last on, cancelled in the fourth; the fold is in leaf order."""
    starts, process = _waves(spark, sf_dir)
    left, run = list(starts), control.RunControl()

    def step(leaves: list) -> tuple[str, int]:
        if len(left) == len(starts) - 4:
            run.cancel()
            raise RuntimeError("interrupted")
        total, n = process(leaves)
        return str(total), n

    got = control.pull(lambda p: [left.pop()] if left else None, step, lambda a, b: f"{a},{b}", str, control=run)
    return spark.range(1).select(F.lit(got.stopped).alias("stopped"), F.lit(got.value).alias("totals"))


@registered(REGISTRY, "SELECT 0 AS place, count(*) AS n FROM orders UNION ALL SELECT 1, count(*) FROM customer UNION ALL SELECT 2, count(*) FROM supplier")
def queued_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: plans run one after another in the order given."""
    done: list[tuple[int, int]] = []
    with control.PlanQueue(2) as queue:
        futures = [queue.submit(lambda i=i, t=t: done.append((i, read_table(spark, sf_dir, t).count()))) for i, t in enumerate(("orders", "customer", "supplier"))]
        for f in futures:
            f.result()
    rows = [F.struct(F.lit(at).alias("place"), F.lit(n).cast("long").alias("n")) for at, (_, n) in enumerate(done)]
    return spark.range(1).select(F.inline(F.array(*rows)))


@registered(REGISTRY, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: every event delivered twice, each kept once."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    path = shared_path(spark, "delivered")
    e.write.parquet(path)
    e.write.mode("append").parquet(path)
    out = shared_path(spark, "deduped")
    stream = dedup(spark.readStream.schema(e.schema).parquet(path), "at", "1 hour", "event_id")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
