"""Golden values and edge cases of the engine's operators."""

import hashlib
import math
import pickle
import threading
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.functions import arrays as A
from spindrift.functions import kinematics as K
from spindrift.operators import exchange as X
from spindrift.operators import join as J
from spindrift.operators.externals import External, binned_lookup, combine_leaves, map_leaves, retrying
from spindrift.operators.hist import Fill, Regular, dense, fill, write_json
from spindrift.operators.reduce import collate, counters, finalize, spend_failures, tree_fold, tree_fold_levels
from spindrift.operators.vary import Family, matrix, vary
from spindrift.plans import control
from spindrift.sources.readers import from_memory, register_source, step_bounds, step_of, warn_few_tasks, with_file_row
from spindrift.sources.sinks import PartialStore, write_parts, write_result
from spindrift.streaming.windows import dedup, pull_files

# Destinations of some keys among 1000.
ROUTES = {0: 850, 1: 730, 2: 13, 3: 948, 7: 212, 42: 938, 255: 490, 256: 983, 1000: 516, 2**32: 795, 2**63: 437, 2**64 - 1: 325}


def signed(k):
    return k - 2**64 if k >= 2**63 else k


def test_pinned_route(spark):
    df = spark.createDataFrame([(signed(k),) for k in ROUTES], "k long")
    got = {r[0]: r[1] for r in df.select("k", X.route(F.col("k"), 1000)).collect()}
    assert got == {signed(k): v for k, v in ROUTES.items()}
    assert spark.createDataFrame([(None,)], "k long").select(X.route(F.col("k"), 5)).first()[0] == 0
    with pytest.raises(ValueError):
        X.route(F.col("k"), 0)


def test_placement_and_order(spark):
    blocks = [list(range(8)), list(range(7, -1, -1)), [10, 11, 12, 13] * 2, [100, 200, 300, 400], [1, 1, 2, 2, 3, 3], list(range(42, 50))]
    rows = [(s, i, k) for s, b in enumerate(blocks) for i, k in enumerate(b)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = X.repartition_by_key(spark.createDataFrame(rows, "src int, i int, k long"), "k", 4, ["src", "i"])
        got = [tuple(r) for r in placed.withColumn("p", F.spark_partition_id()).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r[3] == r[4] for r in got)
    assert sorted(r[:3] for r in got) == sorted(rows)
    for p in range(4):
        mine = [r[:2] for r in got if r[4] == p]
        assert mine == sorted(mine)


def test_fingerprint_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 7 % 11).alias("v"))
    one = X.fingerprint(X.repartition_by_key(df, "k", 4, ["k"]), "dest", ["k"], ["k", "v"]).collect()
    many = X.fingerprint(X.repartition_by_key(df.repartition(7), "k", 4, ["k"]), "dest", ["k"], ["k", "v"]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_rebalance_and_union(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "i int, s int")
    got = {r[0]: r[1] for r in X.rebalance_by_size(df, ["i"], F.col("s"), 40).select("i", "bucket").collect()}
    assert got == {i: i * 10 // 40 for i in range(20)}
    assert X.union_blocks(df, df).where("src_pid = 1").count() == 20
    assert X.rebalance(df).count() == 20


LEFT = [(1, 10), (2, 21), (2, 22), (4, 40)]
RIGHT = [(2, 200), (3, 300), (3, 301), (5, 500)]
INNER = {(2, 21, 200), (2, 22, 200)}
LEFT_ONLY, RIGHT_ONLY = {(1, 10, None), (4, 40, None)}, {(3, None, 300), (3, None, 301), (5, None, 500)}


@pytest.mark.parametrize(("how", "rows"), [("inner", INNER), ("left", INNER | LEFT_ONLY), ("right", INNER | RIGHT_ONLY), ("outer", INNER | LEFT_ONLY | RIGHT_ONLY)])
@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle", "sort"])
def test_joins(spark, how, rows, strategy):
    a, b = spark.createDataFrame(LEFT, "k long, l long"), spark.createDataFrame(RIGHT, "k long, r long")
    assert {tuple(r) for r in J.join(a, b, ["k"], how, strategy).select("k", "l", "r").collect()} == rows


@pytest.mark.parametrize("how", ["inner", "right"])
def test_salted_join(spark, how):
    a, b = spark.createDataFrame([(7, i) for i in range(27)] + [(3, 1)], "k long, l long"), spark.createDataFrame([(7, i) for i in range(27)] + [(99, 1)], "k long, r long")
    salted = sorted(map(tuple, J.join(a, b, ["k"], how, "salted", salt=3).select("k", F.coalesce("l", F.lit(-1)), "r").collect()))
    assert salted == sorted(map(tuple, J.join(a, b, ["k"], how).select("k", F.coalesce("l", F.lit(-1)), "r").collect()))


def test_join_refuses_what_does_not_apply(spark):
    a, b = spark.createDataFrame(LEFT, "k long, l long"), spark.createDataFrame(RIGHT, "k long, r long")
    for wrong in ({"how": "cross"}, {"strategy": "magic"}, {"salt": 2}, {"strategy": "sort", "parts": 4}, {"strategy": "salted", "how": "left"}):
        with pytest.raises(ValueError):
            J.join(a, b, ["k"], **wrong)


def test_empty_sides(spark):
    a, none = spark.createDataFrame(LEFT, "k long, l long"), spark.createDataFrame([], "k long, r long")
    assert J.join(a, none, ["k"], "left").count() == 4
    assert J.join(none, a, ["k"], "left").count() == 0
    assert J.broadcast_with_tail(a, none, ["k"]).count() == 4


def test_cost_rule_is_strict():
    assert J.choose_broadcast(10, 41, 5)
    assert not J.choose_broadcast(10, 40, 5)
    assert not J.choose_broadcast(10, 39, 5)
    assert J.choose_broadcast(10, 39, 5, broadcast=True)


def test_broadcast_tail_emits_unmatched_once(spark):
    a, b = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, l long"), spark.createDataFrame([(2, 200), (2, 201), (2, 202), (3, 203)], "k long, r long").repartition(3)
    assert {tuple(r) for r in J.broadcast_with_tail(a, b, ["k"]).collect()} == {(1, 10, None), (2, 20, 200), (2, 20, 201), (2, 20, 202), (3, 30, 203)}


def test_range_semi_join(spark):
    rows, ranges = spark.createDataFrame([(1, v) for v in range(10)] + [(2, 5)], "k int, v int"), spark.createDataFrame([(1, 2, 4), (1, 3, 6), (3, 0, 9), (1, 9, 8)], "k int, lo int, hi int")
    assert sorted(map(tuple, J.range_semi_join(rows, ranges, "k", "v").collect())) == [(1, v) for v in (2, 3, 4, 5, 6)]


def test_tree_fold_keeps_the_documented_grouping(spark):
    leaves = spark.createDataFrame([(i, 1e16 if i == 0 else 1.0) for i in range(9)], "leaf int, v double")
    for df in (leaves, leaves.repartition(5), leaves.orderBy(F.desc("leaf"))):
        assert tree_fold(df, "leaf", "v").first()[0] == 10000000000000008.0
    assert tree_fold_levels(leaves, "leaf", "v").first()[0] == 10000000000000008.0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 16, 17])
def test_tree_shape(spark, n):
    def tree(items):
        while len(items) > 1:
            items = [f"({items[i]}{items[i + 1]})" if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
        return items[0]

    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(n)], "leaf int, v string")
    got = tree_fold(df, "leaf", "v", combine=lambda a, b: F.concat(F.lit("("), a, b, F.lit(")"))).first()[0]
    assert got == tree([chr(97 + i) for i in range(n)])


def test_histogram_smoke(spark):
    df = spark.createDataFrame([(e,) for e in [[40.0, 25.0], [55.0], [30.0, 60.0, 20.0], [80.0], [15.0, 45.0], [70.0, 10.0]]], "pt array<double>")
    axis = Regular(4, 0, 100)
    got = dense(fill(df, [Fill("h", axis, F.col("pt"), many=True)]), {"h": axis}).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 3, 4, 3, 1, 0]


def test_histogram_edges(spark, tmp_path):
    values = [-1.0, 0.0, 99.999, 100.0, float("nan"), None, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    axis = Regular(10, 0, 100)
    filled = fill(df, [Fill("h", axis, F.col("x"), weight=F.lit(0.5))])
    assert {r["bin"]: (r["n"], r["sumw"], r["sumw2"]) for r in filled.collect()} == {0: (2, 1.0, 0.5), 1: (1, 0.5, 0.25), 10: (1, 0.5, 0.25), 11: (3, 1.5, 0.75)}
    write_json(filled, f"{tmp_path}/h")
    assert spark.read.json(f"{tmp_path}/h").count() == 4
    assert fill(df.where(F.lit(False)), [Fill("h", axis, F.col("x"))]).count() == 0
    with pytest.raises(ValueError):
        Regular(0, 0, 1)
    with pytest.raises(ValueError):
        fill(df, [Fill("h", axis, F.col("x"))] * 2)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_histograms_do_not_depend_on_chunks(spark, parts):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("x")).repartition(parts)
    got = fill(df, [Fill("h", Regular(7, 0, 100), F.col("x"))]).orderBy("bin").select("bin", "n").collect()
    expected = Counter(8 if x >= 100 else int(x / 100 * 7) + 1 for x in (i * 37 % 101 for i in range(500)))
    assert {r["bin"]: r["n"] for r in got} == expected


def test_arrays(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 1.0],), ([],), ([5.0],)], "a array<double>")
    a = F.col("a")
    row = lambda c: [r[0] for r in df.select(c).collect()]
    assert row(A.num(a)) == [4, 0, 1]
    assert row(A.total(a)) == [7.0, 0.0, 5.0]
    assert row(A.product(a)) == [6.0, 1.0, 5.0]
    assert row(A.any_of(a, lambda x: x > 2)) == [True, False, True]
    assert row(A.all_of(a, lambda x: x > 2)) == [False, True, True]
    assert row(A.argmin(a)) == [1, None, 0]
    assert row(A.argsort(a)) == [[1, 3, 2, 0], [], [0]]
    assert row(A.argsort(a, ascending=False)) == [[0, 2, 1, 3], [], [0]]
    assert row(A.local_index(a)) == [[0, 1, 2, 3], [], [0]]
    assert row(A.first(a)) == [3.0, None, 5.0]
    assert row(A.nth(a, 1, -999.0)) == [1.0, -999.0, -999.0]
    assert row(A.pad(a, 2)) == [[3.0, 1.0, 2.0, 1.0], [None, None], [5.0, None]]
    assert row(A.drop_none(A.pad(a, 2))) == [[3.0, 1.0, 2.0, 1.0], [], [5.0]]
    assert row(A.fill_none(A.pad(a, 2), 0.0)) == [[3.0, 1.0, 2.0, 1.0], [0.0, 0.0], [5.0, 0.0]]
    assert row(A.full_like(a, 1)) == [[1] * 4, [], [1]]
    assert row(F.transform(A.pairs(a), lambda p: p["a"] * 10 + p["b"])) == [[31.0, 32.0, 31.0, 12.0, 11.0, 21.0], [], []]
    assert row(F.transform(A.triples(a), lambda t: t["a"] * 100 + t["b"] * 10 + t["c"])) == [[312.0, 311.0, 321.0, 121.0], [], []]
    assert row(A.num(F.flatten(A.cross(a, a)))) == [16, 0, 1]
    assert row(A.joined(a, a))[2] == [5.0, 5.0]
    assert row(A.regroup(a, F.when(F.size(a) == 4, F.array(F.lit(1), F.lit(0), F.lit(3))).otherwise(F.array(F.size(a)))))[0] == [[3.0], [], [1.0, 2.0, 1.0]]
    assert row(A.sort_by(a, lambda x: x, descending=True))[0] == [3.0, 2.0, 1.0, 1.0]
    assert [tuple(x) for x in row(A.zipped(x=a, y=a))[2]] == [(5.0, 5.0)]


def test_flags_and_flat_records(spark):
    df = spark.createDataFrame([(True, False, (1, 2))], "f_a boolean, f_b boolean, s struct<y:int,x:int>")
    assert df.select(A.flags(df, "f_"), A.flags(df, "f_", "or"), A.flags(df, "none")).first()[:] == (False, True, True)
    assert df.select(*A.flattened(df, {"s": "lead_"})).columns == ["lead_x", "lead_y"]
    with pytest.raises(ValueError):
        A.flags(df, "f_", "xor")


def test_kinematics(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(K.delta_phi(F.lit(3.0), F.lit(-3.0))) == pytest.approx(6 - 2 * math.pi)
    assert val(K.delta_phi(F.lit(-3.0), F.lit(3.0))) == pytest.approx(2 * math.pi - 6)
    p = F.struct(F.lit(3.0).alias("pt"), F.lit(0.0).alias("eta"), F.lit(0.0).alias("phi"), F.lit(4.0).alias("mass"))
    assert val(K.energy(p)) == pytest.approx(5.0)
    assert val(K.mass_of(K.add(p))) == pytest.approx(4.0)
    assert val(K.pt_of(K.add(p, p))) == pytest.approx(6.0)
    assert math.isnan(val(K.safe_log(F.lit(-1.0)))) and val(K.safe_log(F.lit(0.0))) == float("-inf")
    assert val(K.above(F.lit(float("nan")), 5)) is False
    assert val(K.rint_to(F.lit(2.5), 1.0)) == 2.0


def test_counters_collate_finalize(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (2.0,)], "w double")
    assert df.agg(*counters("w")).first()[:] == (3, 2, 1, 1, 2.0)
    assert df.where(F.lit(False)).agg(*counters("w")).first()[:] == (0, 0, 0, 0, 0.0)
    both = collate({"b": df, "a": df})
    assert {r["dataset"] for r in both.collect()} == {"a", "b"} and both.count() == 6
    assert finalize(df, len) == 3
    with pytest.raises(ValueError):
        collate({})


def test_variations_are_siblings(spark):
    df = spark.createDataFrame([(1,)], "x int")
    got = {r["variation"]: (r["s"], r["w"]) for r in vary(df, {"s": 1.0, "w": 1.0}, [Family("jes", {"up": {"s": 1.05}}), Family("b", {"up": {"w": 2.0}})]).collect()}
    assert got == {"nominal": (1.0, 1.0), "jes_up": (1.05, 1.0), "b_up": (1.0, 2.0)}
    with pytest.raises(ValueError):
        vary(df, {"s": 1.0}, [Family("f", {"up": {"t": 1.0}})])


def test_matrix_tags_each_output(spark):
    df = vary(spark.range(4), {"s": 1.0}, [Family("f", {"up": {"s": 2.0}})])
    sums = lambda test: lambda v: v.where(test).groupBy("variation").agg(F.sum(F.col("id") * F.col("s")).alias("t"))
    got = {(r["output"], r["variation"]): r["t"] for r in matrix(df, {"all": sums("true"), "odd": sums("id % 2 = 1")}).collect()}
    assert got == {("all", "nominal"): 6.0, ("all", "f_up"): 12.0, ("odd", "nominal"): 4.0, ("odd", "f_up"): 8.0}
    with pytest.raises(ValueError):
        matrix(df, {})


def test_user_code_budget_and_fold(spark):
    df = spark.range(40).select((F.col("id") % 8).alias("leaf"), F.col("id").alias("v"))

    def process(group: pa.Table):
        if group.column("leaf")[0].as_py() == 3:
            raise ValueError("bad leaf")
        return sum(group.column("v").to_pylist())

    results = map_leaves(df, "leaf", process, catch=True)
    good, failed = spend_failures(results, 1)
    assert failed == 1
    assert combine_leaves(good, lambda a, b: a + b, lambda: 0) == sum(i for i in range(40) if i % 8 != 3)
    with pytest.raises(RuntimeError, match="bad leaf"):
        spend_failures(results, 0)
    names = map_leaves(df, "leaf", lambda g: str(g.column("leaf")[0].as_py()))
    assert combine_leaves(names, lambda a, b: f"({a}{b})", str, fan=4) == "(((01)(23))((45)(67)))"
    assert combine_leaves(names.where(F.lit(False)), lambda a, b: a, lambda: "empty") == "empty"


def test_retry():
    tries = []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return 5

    assert retrying(fails, 2)() == 5
    with pytest.raises(ZeroDivisionError):
        retrying(lambda: 1 / 0, 1)()


def test_external_and_lookup(spark):
    ext = External("add", b"5", int, lambda r, t: pa.table({"y": pa.array([x + r for x in t.column("id").to_pylist()], pa.int64())}), "y long")
    assert sorted(r[0] for r in ext.apply(spark.range(3)).collect()) == [5, 6, 7]
    assert len(ext.digest) == 64
    table = spark.createDataFrame([("a", 0.0, 1.0, 10.0), ("a", 1.0, 2.0, 20.0)], "d string, lo double, hi double, f double")
    got = binned_lookup(spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 2.0), ("b", 0.5)], "d string, x double"), table, {"x": ("lo", "hi")}, "f", ["d"])
    assert [r["f"] for r in got.orderBy("d", "x").collect()] == [10.0, 20.0, None, None]


def test_adaptive_pull_stops_and_cancels():
    chunks = [100] * 4 + [400] * 2
    ask = lambda p: [p.leaves] if p.leaves < len(chunks) else None
    run = lambda **kw: control.pull(ask, lambda leaves: (chunks[leaves[0]], chunks[leaves[0]]), lambda a, b: a + b, lambda: 0, **kw)
    whole = run()
    assert (whole.value, whole.n_partitions, whole.n_combines, whole.stopped) == (1200, 6, 5, None)
    early = run(stop=control.Stop(entries=500))
    assert early.value == 800 and early.stopped == "entries"
    c = control.RunControl()
    c.cancel()
    gone = run(control=c)
    assert (gone.value, gone.n_partitions, gone.stopped) == (0, 0, "cancelled")
    assert c.state == "RUNNING"
    c.pause()
    assert c.state == "PAUSED"
    threading.Timer(0.2, c.resume).start()
    assert run(control=c, finalize=lambda v: -v).value == -1200


def test_plan_queue_keeps_order():
    seen = []
    with control.PlanQueue(2) as q:
        futures = [q.submit(lambda i=i: seen.append(i) or i) for i in range(5)]
        assert [f.result() for f in futures] == list(range(5)) == seen
    assert [len(w) for w in control.in_waves(range(7), 3)] == [3, 3, 1]


def test_steps(spark):
    assert step_bounds(48, 13)[-1] == (45, 48) and step_bounds(0, 2) == [(0, 0), (0, 0)]
    got = {r[0]: r[1] for r in spark.range(10).select("id", step_of(F.col("id"), 10, 4)).collect()}
    assert got == {i: s for s, (a, b) in enumerate(step_bounds(10, 4)) for i in range(a, b)}


def test_sources_and_sinks(spark, tmp_path, sf_dir):
    rows = with_file_row(spark.read.parquet(f"{sf_dir}/nation.parquet"))
    assert sorted(r["row_in_file"] for r in rows.collect()) == list(range(25))
    assert from_memory(spark, pa.table({"x": [1, 2]})).count() == 2
    assert from_memory(spark, [{"x": 1}], "x int").first()[0] == 1
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "d string, leaf int, v double")
    summary = write_parts(df, f"{tmp_path}/out", ["d", "leaf"], [F.sum("v").alias("v")])
    assert summary.count() == 3 and spark.read.parquet(f"{tmp_path}/out/parts").count() == 3
    assert write_result(df, f"{tmp_path}/r").count() == 3
    warn_few_tasks(df.coalesce(1))


def test_partial_store_resumes(spark, tmp_path):
    store = PartialStore(spark, str(tmp_path), "sum of v by leaf, v1")
    leaves = spark.createDataFrame([(i,) for i in range(5)], "leaf long")
    schema = "leaf long, v double"
    assert store.missing(leaves, schema).count() == 5
    store.add(leaves.where("leaf < 3").withColumn("v", F.lit(1.0)))
    assert sorted(r[0] for r in store.missing(leaves, schema).collect()) == [3, 4]
    assert PartialStore(spark, str(tmp_path), "another plan").missing(leaves, schema).count() == 5


def test_custom_source(spark):
    register_source(spark, "counting", "x long", lambda o: list(range(int(o.get("parts", 2)))), lambda spec, o: iter([pa.RecordBatch.from_arrays([pa.array([spec * 10, spec * 10 + 1])], names=["x"])]))
    assert sorted(r[0] for r in spark.read.format("counting").option("parts", 3).load().collect()) == [0, 1, 10, 11, 20, 21]


def test_streaming_pull_and_dedup(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(100).select("id", F.timestamp_seconds(F.col("id") + 86400).alias("ts")).repartition(5).write.parquet(src)
    totals = []
    schema = "id long, ts timestamp"
    waves = pull_files(spark, src, schema, lambda b, n: totals.append(b.agg(F.sum("id")).first()[0]), f"{tmp_path}/cp", files_per_wave=2)
    assert waves >= 2 and sum(totals) == sum(range(100))
    assert pull_files(spark, src, schema, lambda b, n: totals.append(0), f"{tmp_path}/cp", files_per_wave=2) == 0
    stream = dedup(spark.readStream.schema(schema).parquet(src), "ts", "1 hour", "id")
    q = stream.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 100


def test_staged_join_example(spark):
    a, b = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0)], "run int, met double"), spark.createDataFrame([(1, 0.9), (2, 1.1)], "run int, w double")
    got = J.join(a.withColumn("met", F.col("met") * 2), b, ["run"]).select((F.col("met") * F.col("w")).alias("v")).collect()
    assert sorted(round(r[0], 6) for r in got) == [18.0, 36.0, 66.0]


def test_many_sparse_leaves_fold_in_the_fixed_tree(spark):
    both = lambda a, b: hashlib.md5(a + b).digest()
    n = 100_001
    leaves = [i.to_bytes(8, "big") for i in range(n)]
    rows = spark.createDataFrame(pa.table({"leaf": pa.array([3 * i // 2 for i in range(n)]), "value": pa.array([pickle.dumps(v) for v in leaves])}))
    while len(leaves) > 1:
        leaves = [both(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    assert combine_leaves(rows, both, bytes) == leaves[0]
