"""Event analyses over nested objects, ending in histograms: the ladder of eight, and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kinematics as K
from ..operators.hist import Fill, Regular, dense, fill
from ..operators.reduce import collate, counters
from ..operators.vary import Family, vary
from ..sources.readers import read_table
from .base import MET, OBJ, Registry, bin_sql, dphi_sql, events, hist_sql, isum, isum_sql, mass_sql, mets, objects, pt_sql, registered, rounded_sql

REGISTRY: Registry = {}
MET_AXIS, PT_AXIS, SUM_AXIS = Regular(50, 0.0, 500.0), Regular(40, 0.0, 100.0), Regular(50, 0.0, 300.0)


def _counts(df: DataFrame, *fills: Fill) -> DataFrame:
    return fill(df, fills).select("hist", "bin", "n")


@registered(REGISTRY, "SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@registered(REGISTRY, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def filter_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@registered(REGISTRY, f"WITH {OBJ} SELECT ev, CAST(count(*) FILTER (abs(eta) < 1) AS INTEGER) AS n_central, {isum_sql('CASE WHEN abs(eta) < 1 THEN pt ELSE 0 END', 1000000)} AS pt_e6 FROM obj GROUP BY ev")
def filter_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter("obj", lambda o: F.abs(o["eta"]) < 1)
    whole = F.aggregate(kept, F.lit(0).cast("long"), lambda acc, o: acc + F.rint(o["pt"] * 1e6).cast("long"))
    return objects(spark, sf_dir).select("ev", A.num(kept).alias("n_central"), whole.alias("pt_e6"))


@registered(REGISTRY, f"WITH {MET} " + hist_sql("hist_price", MET_AXIS, "met", "met"))
def hist_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(mets(spark, sf_dir), Fill("hist_price", MET_AXIS, F.col("met")))


@registered(REGISTRY, f"WITH {OBJ} " + hist_sql("hist_jet_all", PT_AXIS, "pt", "obj"))
def hist_jet_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object fills, so the flat table needs no regrouping into events."""
    d = read_table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000.0).alias("pt"))
    return _counts(d, Fill("hist_jet_all", PT_AXIS, F.col("pt")))


@registered(REGISTRY, f"WITH {OBJ} " + hist_sql("hist_object_cut", PT_AXIS, "pt", "obj", "abs(eta) < 1"))
def hist_object_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    central = F.transform(F.filter("obj", lambda o: F.abs(o["eta"]) < 1), lambda o: o["pt"])
    return _counts(objects(spark, sf_dir), Fill("hist_object_cut", PT_AXIS, central, many=True))


@registered(REGISTRY, f"WITH {OBJ}, {MET} " + hist_sql("hist_njet_ge2", MET_AXIS, "met", "met", "ev IN (SELECT ev FROM obj WHERE pt > 40 GROUP BY ev HAVING count(*) >= 2)"))
def hist_njet_ge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = A.num(F.filter("obj", lambda o: o["pt"] > 40)) >= 2
    return _counts(events(spark, sf_dir), Fill("hist_njet_ge2", MET_AXIS, F.col("met"), where=two))


@registered(
    REGISTRY,
    f"WITH {OBJ}, {MET}, hit AS (SELECT DISTINCT a.ev FROM obj a JOIN obj b ON a.ev = b.ev AND a.rn < b.rn WHERE a.flag = 'A' AND b.flag = 'A' AND a.charge <> b.charge AND {mass_sql('a', 'b')} > 60 AND {mass_sql('a', 'b')} < 120) "
    + hist_sql("hist_pair_window", MET_AXIS, "met", "met", "ev IN (SELECT ev FROM hit)"),
)
def hist_pair_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    muons = F.filter("obj", lambda o: o["flag"] == "A")

    def near(p):
        m = K.pair_mass(p["a"], p["b"])
        return (p["a"]["charge"] != p["b"]["charge"]) & (m > 60) & (m < 120)

    d = events(spark, sf_dir).select("met", muons.alias("mu")).where(F.size("mu") >= 2)
    return _counts(d, Fill("hist_pair_window", MET_AXIS, F.col("met"), where=A.any_of(A.pairs(F.col("mu")), near)))


@registered(
    REGISTRY,
    f"WITH {OBJ}, best AS (SELECT v FROM (SELECT {rounded_sql(pt_sql('a', 'b', 'c'))} AS v, row_number() OVER (PARTITION BY a.ev ORDER BY abs({mass_sql('a', 'b', 'c')} - 172.5), a.rn, b.rn, c.rn) AS k FROM obj a JOIN obj b ON a.ev = b.ev AND a.rn < b.rn JOIN obj c ON b.ev = c.ev AND b.rn < c.rn) WHERE k = 1) "
    + hist_sql("hist_best_triple", SUM_AXIS, "v", "best"),
)
def hist_best_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = objects(spark, sf_dir).where(F.size("obj") >= 3).select(F.transform("obj", K.vector).alias("vec"))
    made = F.transform(A.triples(F.col("vec")), lambda t: K.total(t["a"], t["b"], t["c"]))
    d = d.select(A.min_by(made, lambda v: F.abs(K.mass_of(v) - 172.5)).alias("v"))
    return _counts(d, Fill("hist_best_triple", SUM_AXIS, K.rint_to(K.pt_of(F.col("v")))))


def _far(jet, leptons):
    return A.all_of(leptons, lambda lep: K.delta_r(jet["eta"], jet["phi"], lep["eta"], lep["phi"]) > 0.4)


@registered(
    REGISTRY,
    f"""WITH {OBJ}, good AS (SELECT j.ev, j.pt FROM obj j WHERE j.flag = 'N' AND j.pt > 30 AND NOT EXISTS (SELECT 1 FROM obj l WHERE l.ev = j.ev AND l.flag <> 'N' AND l.pt > 10
 AND NOT (sqrt(pow(j.eta - l.eta, 2) + pow({dphi_sql("j.phi", "l.phi")}, 2)) > 0.4))),
 tot AS (SELECT e.ev, {rounded_sql("coalesce(sum(g.pt), 0)")} AS v FROM (SELECT DISTINCT ev FROM obj) e LEFT JOIN good g ON e.ev = g.ev GROUP BY e.ev) """
    + hist_sql("isolated_sum", SUM_AXIS, "v", "tot"),
)
def isolated_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    muons = F.filter("obj", lambda o: (o["flag"] == "A") & (o["pt"] > 10))
    electrons = F.filter("obj", lambda o: (o["flag"] == "R") & (o["pt"] > 10))
    d = objects(spark, sf_dir).select("obj", A.joined(muons, electrons).alias("lep"))
    jets = F.filter("obj", lambda o: (o["flag"] == "N") & (o["pt"] > 30) & _far(o, F.col("lep")))
    return _counts(d, Fill("isolated_sum", SUM_AXIS, K.rint_to(A.total(F.transform(jets, lambda o: o["pt"])))))


@registered(
    REGISTRY,
    f"""WITH {OBJ}, {MET}, lep AS (SELECT *, CAST(row_number() OVER (PARTITION BY ev ORDER BY pt DESC, flag, rn) AS INTEGER) AS k FROM obj WHERE flag <> 'N'),
 pair AS (SELECT ev, i, j FROM (SELECT a.ev, a.k AS i, b.k AS j, row_number() OVER (PARTITION BY a.ev ORDER BY abs({mass_sql("a", "b")} - 91.2), a.k, b.k) AS z FROM lep a JOIN lep b ON a.ev = b.ev AND a.k < b.k AND a.flag = b.flag AND a.charge <> b.charge) WHERE z = 1),
 lead AS (SELECT l.ev, arg_min(l.pt, l.k) AS pt, arg_min(l.phi, l.k) AS phi FROM lep l JOIN pair p ON l.ev = p.ev AND l.k <> p.i AND l.k <> p.j GROUP BY l.ev),
 v AS (SELECT {rounded_sql("sqrt(2 * m.met * l.pt * (1 - cos(" + dphi_sql("m.met_phi", "l.phi") + ")))")} AS v FROM lead l JOIN met m ON l.ev = m.ev) """
    + hist_sql("lead_other_after_best_pair", SUM_AXIS, "v", "v"),
)
def lead_other_after_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = A.with_field(F.filter("obj", lambda o: o["flag"] == "A"), "flavour", lambda o: F.lit(0))
    el = A.with_field(F.filter("obj", lambda o: o["flag"] == "R"), "flavour", lambda o: F.lit(1))
    # no row filter on the way: a filter would be pushed below the projections and repeat their work;
    # events without a pair or a remaining lepton come out null, which fills nothing
    lep = F.transform(A.sort_by(A.joined(mu, el), lambda o: o["pt"], descending=True), lambda o, i: F.struct(o["pt"].alias("pt"), o["phi"].alias("phi"), o["flavour"].alias("flavour"), o["charge"].alias("charge"), i.alias("k"), K.vector(o).alias("v")))
    d = events(spark, sf_dir).select("met", "met_phi", lep.alias("lep"))
    fits = F.filter(A.pairs(F.col("lep")), lambda p: (p["a"]["flavour"] == p["b"]["flavour"]) & (p["a"]["charge"] != p["b"]["charge"]))
    best = A.min_by(fits, lambda p: F.abs(K.mass_of(K.total(p["a"]["v"], p["b"]["v"])) - 91.2))
    d = d.withColumn("best", F.when(F.size("lep") >= 3, best))
    d = d.withColumn("lead", A.first(F.filter("lep", lambda o: (o["k"] != F.col("best.a.k")) & (o["k"] != F.col("best.b.k")))))
    mt = K.transverse_mass(F.col("met"), F.col("met_phi"), F.col("lead.pt"), F.col("lead.phi"))
    return _counts(d, Fill("lead_other_after_best_pair", SUM_AXIS, K.rint_to(mt)))


W = "(1 - l_discount)"


@registered(REGISTRY, f"SELECT 'w' AS hist, CAST(b AS INTEGER) AS bin, count(*) AS n, {isum_sql('w')} AS sumw_e4, {isum_sql('w * w')} AS sumw2_e4 FROM (SELECT {bin_sql('l_quantity', Regular(25, 0.0, 50.0))} AS b, {W} AS w FROM lineitem) GROUP BY b")
def hist_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "lineitem")
    got = fill(d, [Fill("w", Regular(25, 0.0, 50.0), F.col("l_quantity"), weight=1 - F.col("l_discount"))])
    return got.select("hist", "bin", "n", F.rint(F.col("sumw") * 1e4).cast("long").alias("sumw_e4"), F.rint(F.col("sumw2") * 1e4).cast("long").alias("sumw2_e4"))


@registered(REGISTRY, " UNION ALL ".join(hist_sql(n, a, v, "lineitem", w) for n, a, v, w in (("price", Regular(40, 0.0, 100000.0), "l_extendedprice", "TRUE"), ("quantity", Regular(25, 0.0, 50.0), "l_quantity", "TRUE"), ("tax_of_returned", Regular(10, 0.0, 0.1), "l_tax", "l_returnflag = 'R'"))))
def hist_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "lineitem")
    return _counts(d, Fill("price", Regular(40, 0.0, 100000.0), F.col("l_extendedprice")), Fill("quantity", Regular(25, 0.0, 50.0), F.col("l_quantity")), Fill("tax_of_returned", Regular(10, 0.0, 0.1), F.col("l_tax"), where=F.col("l_returnflag") == "R"))


@registered(REGISTRY, f"SELECT g.hist, g.bin, coalesce(h.n, 0) AS n FROM (SELECT 'balance' AS hist, CAST(range AS INTEGER) AS bin FROM range(0, 32)) g LEFT JOIN ({hist_sql('balance', Regular(30, -5000.0, 20000.0), 'c_acctbal', 'customer')}) h ON g.bin = h.bin")
def hist_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = Regular(30, -5000.0, 20000.0)
    return dense(fill(read_table(spark, sf_dir, "customer"), [Fill("balance", axis, F.col("c_acctbal"))]), {"balance": axis}).select("hist", "bin", "n")


_NET = "(l_discount - 0.05)"


def _counters_sql(source: str, w: str = _NET) -> str:
    return f"count(*) AS nTot, count(*) FILTER ({w} > 0) AS nPos, count(*) FILTER ({w} < 0) AS nNeg, count(*) FILTER ({w} > 0) - count(*) FILTER ({w} < 0) AS nEff, {isum_sql(w)} AS genWeightSum_e4 FROM {source}"


@registered(REGISTRY, f"SELECT l_returnflag AS dataset, {_counters_sql('lineitem')} GROUP BY l_returnflag")
def counters_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_discount") - 0.05)
    named = [c for c in counters("w")[:4]]
    return d.groupBy(F.col("l_returnflag").alias("dataset")).agg(*named, isum(F.col("w")).alias("genWeightSum_e4"))


@registered(REGISTRY, " UNION ALL ".join(f"SELECT '{s}' AS dataset, count(*) AS nTot, CAST(count(*) AS DOUBLE) AS genWeightSum FROM orders WHERE o_orderstatus = '{s}'" for s in "FOP"))
def collate_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    one = counters()
    return collate({s: o.where(F.col("o_orderstatus") == s).agg(one[0], one[4]) for s in "FOP"})


_SHIFTS = (("nominal", 1.0, 1.0), ("jes_up", 1.05, 1.0), ("jes_down", 0.95, 1.0), ("w_up", 1.0, 1.03), ("w_down", 1.0, 0.97))
_GRID = "(VALUES " + ", ".join(f"('{n}', {s}::DOUBLE, {w}::DOUBLE)" for n, s, w in _SHIFTS) + ") g(variation, scale, wscale)"


@registered(
    REGISTRY,
    f"""WITH {OBJ}, per AS (SELECT g.variation, o.ev, count(*) AS nj, count(*) FILTER (o.charge > 0) AS nb, {rounded_sql("sum(o.pt * g.scale)")} AS ht, exp(sum(ln((0.95 + 0.1 * o.mass / 5) * g.wscale))) AS w
 FROM obj o, {_GRID} WHERE o.pt * g.scale > 25 GROUP BY g.variation, o.ev HAVING count(*) >= 4)
 SELECT CASE WHEN nb = 1 THEN '4j1b' ELSE '4j2b' END AS output, variation, CAST({bin_sql("ht", Regular(40, 0.0, 800.0))} AS INTEGER) AS bin, count(*) AS n, {isum_sql("w", 1000)} AS sumw_e3
 FROM per WHERE nb >= 1 GROUP BY ALL""",
)
def variation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = [Family("jes", {"up": {"scale": 1.05}, "down": {"scale": 0.95}}), Family("w", {"up": {"wscale": 1.03}, "down": {"wscale": 0.97}})]
    d = vary(objects(spark, sf_dir), {"scale": 1.0, "wscale": 1.0}, families)
    jets = F.filter(A.with_field(F.col("obj"), "pt", lambda o: o["pt"] * F.col("scale")), lambda o: o["pt"] > 25)
    d = d.select("variation", "wscale", jets.alias("jet"))
    nb, ht = A.num(F.filter("jet", lambda o: o["charge"] > 0)), K.rint_to(A.total(F.transform("jet", lambda o: o["pt"])))
    w = A.product(F.transform("jet", lambda o: (0.95 + 0.1 * o["mass"] / 5) * F.col("wscale")))
    # both outputs fill in one pass; whole multiples of 1/1000 keep the sums of weights exact
    d = d.select("variation", F.size("jet").alias("nj"), nb.alias("nb"), ht.alias("ht"), F.rint(w * 1000.0).alias("w"))
    axis = Regular(40, 0.0, 800.0)
    outputs = [Fill(name, axis, F.col("ht"), weight=F.col("w"), where=(F.col("nj") >= 4) & test) for name, test in (("4j1b", F.col("nb") == 1), ("4j2b", F.col("nb") >= 2))]
    return fill(d, outputs, by=["variation"]).select(F.col("hist").alias("output"), "variation", "bin", "n", F.col("sumw").cast("long").alias("sumw_e3"))


@registered(
    REGISTRY,
    f"""WITH {OBJ}, {MET}, pho AS (SELECT *, CAST(row_number() OVER (PARTITION BY ev ORDER BY rn) AS INTEGER) AS k FROM obj WHERE flag <> 'N' AND pt > 18 AND abs(eta) < 2.4 AND NOT (abs(eta) > 1.4442 AND abs(eta) < 1.566)),
 best AS (SELECT * FROM (SELECT a.ev, a.pt AS p1, a.eta AS e1, a.phi AS f1, b.pt AS p2, b.eta AS e2, b.phi AS f2, {rounded_sql(mass_sql("a", "b"))} AS mass, row_number() OVER (PARTITION BY a.ev ORDER BY {pt_sql("a", "b")} DESC, a.k, b.k) AS z FROM pho a JOIN pho b ON a.ev = b.ev AND a.k < b.k WHERE a.pt > 35) WHERE z = 1),
 jet AS (SELECT b.ev, j.pt, row_number() OVER (PARTITION BY b.ev ORDER BY j.rn) AS k FROM best b JOIN obj j ON b.ev = j.ev AND j.flag = 'N' AND j.pt > 30
  AND sqrt(pow(j.eta - b.e1, 2) + pow({dphi_sql("j.phi", "b.f1")}, 2)) > 0.4 AND sqrt(pow(j.eta - b.e2, 2) + pow({dphi_sql("j.phi", "b.f2")}, 2)) > 0.4)
 SELECT b.ev, b.p1 AS lead_pt, b.p2 AS sublead_pt, b.mass, CAST((SELECT count(*) FROM jet j WHERE j.ev = b.ev) AS INTEGER) AS n_jets,
  coalesce((SELECT max(pt) FROM jet j WHERE j.ev = b.ev AND j.k = 1), -999.0::DOUBLE) AS PTJ0, coalesce((SELECT max(pt) FROM jet j WHERE j.ev = b.ev AND j.k = 2), -999.0::DOUBLE) AS PTJ1
 FROM best b""",
)
def diphoton_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photon pairs by falling pair pt, the first of each event, cleaned jets and a flat record."""
    eta = lambda o: F.abs(o["eta"])
    photons = F.filter("obj", lambda o: (o["flag"] != "N") & (o["pt"] > 18) & (eta(o) < 2.4) & ~((eta(o) > 1.4442) & (eta(o) < 1.566)))
    d = objects(spark, sf_dir).select("ev", "obj", photons.alias("pho")).where(F.size("pho") >= 2)
    made = F.transform(F.filter(A.pairs(F.col("pho"), ("lead", "sublead")), lambda p: p["lead"]["pt"] > 35), lambda p: p.withField("sum", K.add(p["lead"], p["sublead"])))
    # a list of at most one, exploded: the choice is made once a row, and events without one go
    chosen = A.drop_none(F.array(A.min_by(made, lambda p: -K.pt_of(p["sum"]))))
    d = d.select("ev", "obj", F.explode(chosen).alias("best"))
    away = lambda o, leg: K.delta_r(o["eta"], o["phi"], F.col(f"best.{leg}.eta"), F.col(f"best.{leg}.phi")) > 0.4
    jets = F.transform(F.filter("obj", lambda o: (o["flag"] == "N") & (o["pt"] > 30) & away(o, "lead") & away(o, "sublead")), lambda o: o["pt"])
    d = d.withColumn("jets", jets)
    return d.select("ev", F.col("best.lead.pt").alias("lead_pt"), F.col("best.sublead.pt").alias("sublead_pt"), K.rint_to(K.mass_of(F.col("best.sum"))).alias("mass"), A.num(F.col("jets")).alias("n_jets"), A.nth(F.col("jets"), 0, -999.0).alias("PTJ0"), A.nth(F.col("jets"), 1, -999.0).alias("PTJ1"))


@registered(REGISTRY, f"WITH {OBJ} SELECT e.ev, CAST(g.range AS INTEGER) AS slot, o.flag AS flag FROM (SELECT ev, max(rn) AS n FROM obj GROUP BY ev) e, range(0, 20) g LEFT JOIN obj o ON o.ev = e.ev AND o.rn = g.range + 1 WHERE g.range < greatest(e.n, 5)")
def array_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.transform("obj", lambda o: o["flag"])
    return objects(spark, sf_dir).select("ev", F.posexplode(A.pad(flags, 5)).alias("slot", "flag"))


@registered(REGISTRY, f"WITH {OBJ} SELECT ev, coalesce(max(CASE WHEN rn = 1 THEN pt END), -1.0::DOUBLE) AS pt0, coalesce(max(CASE WHEN rn = 3 THEN pt END), -1.0::DOUBLE) AS pt2, max(CASE WHEN rn = 6 THEN flag END) AS flag5, CAST(max(rn) AS INTEGER) AS n FROM obj GROUP BY ev")
def array_nth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt, flag = F.transform("obj", lambda o: o["pt"]), F.transform("obj", lambda o: o["flag"])
    return objects(spark, sf_dir).select("ev", A.nth(pt, 0, -1.0).alias("pt0"), A.nth(pt, 2, -1.0).alias("pt2"), A.nth(flag, 5).alias("flag5"), A.num(pt).alias("n"))


@registered(REGISTRY, "SELECT vec_id, CAST(i AS INTEGER) AS run, round_even(list_sum(CAST(embedding[i * 16 + 1 : i * 16 + 16] AS DOUBLE[])) * 1e6, 0) / 1e6 AS total FROM embeddings, (SELECT range AS i FROM range(0, 4))")
def array_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "embeddings").withColumn("runs", A.regroup(F.col("embedding"), F.array(*[F.lit(16)] * 4)))
    return d.select("vec_id", F.posexplode("runs").alias("run", "part")).select("vec_id", "run", K.rint_to(A.total(F.col("part"))).alias("total"))


@registered(REGISTRY, "SELECT vec_id, CAST(k AS INTEGER) AS rank, CAST(i AS INTEGER) AS at FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) - 1 AS k FROM (SELECT vec_id, range AS i, embedding[range + 1] AS v FROM embeddings, range(0, 64))) WHERE k < 3")
def array_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "embeddings").select("vec_id", F.slice(A.argsort(F.col("embedding"), ascending=False), 1, 3).alias("top"))
    return d.select("vec_id", F.posexplode("top").alias("rank", "at"))


@registered(REGISTRY, f"WITH {OBJ} SELECT ev, bool_or(pt > 80) AS any_hard, bool_and(pt > 5) AS all_soft, CAST(arg_min(rn, struct_pack(a := abs(eta), b := rn)) - 1 AS INTEGER) AS most_central, count(*) FILTER (abs({dphi_sql('phi', '0.0::DOUBLE')}) < 1)::INTEGER AS n_front, CAST(max(rn) * (max(rn) - 1) / 2 AS INTEGER) AS n_pairs, CAST(max(rn) * (max(rn) - 1) * (max(rn) - 2) / 6 AS INTEGER) AS n_triples FROM obj GROUP BY ev")
def array_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("obj")
    front = F.filter(o, lambda x: F.abs(K.delta_phi(x["phi"], F.lit(0.0))) < 1)
    return objects(spark, sf_dir).select("ev", A.any_of(o, lambda x: x["pt"] > 80).alias("any_hard"), A.all_of(o, lambda x: x["pt"] > 5).alias("all_soft"), A.argmin(F.transform(o, lambda x: F.abs(x["eta"]))).alias("most_central"), A.num(front).alias("n_front"), A.num(A.pairs(o)).alias("n_pairs"), A.num(A.triples(o)).alias("n_triples"))
