"""Approximate nearest neighbours: a vantage-point tree in each shard.

A top tree over a bounded sample splits unit vectors by chord distance to vantages; its leaves are
regions, and a region's rows are dealt into shards of bounded size, each with a tree of its own,
built once.  A query first searches its home shard, which bounds its k-th distance ``tau``; then it
goes to the other shards of those regions, and to those branches in a shard, that the triangle
inequality does not put farther than ``factor * tau``.  Factor 1 is exact; less prunes more.

Scores are compared to DIGITS decimals, so that the same direction at another length ties, and ties
go to the smaller id.
"""

from __future__ import annotations

import logging
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, require
from .vectors import as_floats, matrix, unit, usable

log = logging.getLogger(__name__)

SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
LEAF_ROWS = 128
FACTOR = 1.0
#: Leaves of the top tree at most, and sampled rows that place each.
REGIONS, ROWS_A_REGION = 512, 64
DIGITS = 12
#: Slack for rounding in chord distances, so that ties are never pruned.
_SLACK = 1e-7


def chord(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of unit rows to a unit vector."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ v)))


class VPTree:
    """A tree over unit row vectors; of rows that tie, those that come first are nearer."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        self.x, self.nodes = x, [None]
        self.scanned = 0
        rng = np.random.default_rng(seed)
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, idx = stack.pop()
            if len(idx) > leaf_rows:
                vantage = x[idx[rng.integers(len(idx))]]
                d = chord(x[idx], vantage)
                mu = float(np.median(d))
                inner = d <= mu
                if 0 < inner.sum() < len(idx):
                    left, right = len(self.nodes), len(self.nodes) + 1
                    self.nodes += [None, None]
                    self.nodes[at] = (vantage, mu, left, right)
                    stack += [(left, idx[inner]), (right, idx[~inner])]
                    continue
            self.nodes[at] = idx

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The node of the leaf that each row falls in."""
        home = np.empty(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                home[who] = at
                continue
            near = chord(x[who], node[0]) <= node[1]
            stack += [(child, sub) for child, sub in ((node[2], who[near]), (node[3], who[~near])) if len(sub)]
        return home

    def within(self, x: np.ndarray, reach: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x): leaves that may hold points no farther than ``reach`` from a row."""
        found, stack = [], [(0, np.arange(len(x)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                found.append((at, who))
                continue
            d = chord(x[who], node[0])
            stack += [(child, sub) for child, sub in ((node[2], who[d - reach[who] <= node[1]]), (node[3], who[d + reach[who] >= node[1]])) if len(sub)]
        return found

    def query(self, q: np.ndarray, k: int, factor: float = FACTOR, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, rows) of the k nearest found for each query, nearest first; row -1 where too few.

        ``least`` are cosines that each query has met k times elsewhere: what is farther may be left out.
        """
        best, rows = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        bound = np.full(len(q), -np.inf) if least is None else least

        def scan(leaf: int, who: np.ndarray) -> None:
            idx = self.nodes[leaf]
            step = max(1, 4_000_000 // max(len(who), 1))
            for a in range(0, len(idx), step):
                part = idx[a : a + step]
                self.scanned += len(part) * len(who)
                s = np.concatenate([best[who], np.round(q[who] @ self.x[part].T, DIGITS)], axis=1)
                r = np.concatenate([rows[who], np.broadcast_to(part, (len(who), len(part)))], axis=1)
                top = np.lexsort((r, -s), axis=1)[:, :k]
                best[who], rows[who] = np.take_along_axis(s, top, 1), np.take_along_axis(r, top, 1)

        home = self.leaf_of(q)
        for leaf in np.unique(home):
            scan(int(leaf), np.flatnonzero(home == leaf))
        stack = [(0, np.arange(len(q)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                who = who[home[who] != at]
                if len(who):
                    scan(at, who)
                continue
            d = chord(q[who], node[0])
            reach = _reach(np.maximum(best[who, -1], bound[who]), factor)
            stack += [(child, sub) for child, sub in ((node[2], who[d - reach <= node[1]]), (node[3], who[d + reach >= node[1]])) if len(sub)]
        return best, rows


def _reach(cosine: np.ndarray, factor: float) -> np.ndarray:
    """The chord distance within which a better point may lie; all of them where none is known."""
    return np.where(np.isneginf(cosine), np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(cosine, -1.0))) * factor + _SLACK)


class _Shard:
    """A tree over the distinct directions of a shard's rows, and the rows of each."""

    def __init__(self, stored: pa.Table, k: int):
        order = sorted(zip(stored.column("vec_id").to_pylist(), stored.column("uid").to_pylist(), range(stored.num_rows)), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
        self.ids, self.uids = [t[0] for t in order], [t[1] for t in order]
        x = unit(matrix(stored.column("v")).astype(np.float64)[[t[2] for t in order]])
        # rows come by id, so a direction's first row is its smallest, and so are directions that tie
        _, first, point = np.unique(np.round(x, DIGITS) + 0.0, axis=0, return_index=True, return_inverse=True)
        by_id = np.argsort(first)
        place = np.empty(len(first), np.int64)
        place[by_id] = np.arange(len(first))
        self.members: list[list[int]] = [[] for _ in first]
        for row, p in enumerate(place[point.ravel()].tolist()):
            if len(self.members[p]) <= k:
                self.members[p].append(row)
        self.tree = VPTree(x[first[by_id]])

    def search(self, queries: pa.Table, k: int, factor: float) -> pa.Table:
        """The k nearest rows here of each query, itself apart."""
        out: list[list] = [[], [], [], [], []]
        q = unit(matrix(queries.column("v")).astype(np.float64))
        self.tree.scanned = 0
        _, rows = self.tree.query(q, min(k + 1, len(self.tree.x)), factor, queries.column("least").to_numpy())
        for i, (uid, qid) in enumerate(zip(queries.column("uid").to_pylist(), queries.column("vec_id").to_pylist())):
            near = rows[i][rows[i] >= 0]
            scores = np.clip((self.tree.x[near] * q[i]).sum(axis=1), -1.0, 1.0)
            found = [(-round(s, DIGITS), row, s) for s, p in zip(scores.tolist(), near.tolist()) for row in self.members[p] if self.uids[row] != uid]
            for _, row, s in sorted(found)[:k]:
                for column, value in zip(out, (uid, qid, self.ids[row], s, 0)):
                    column.append(value)
        if out[4]:
            out[4][0] = self.tree.scanned
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(_NAMES, out)})


_NAMES = ("query_uid", "query_id", "vec_id", "score", "scanned")
_FOUND = "query_uid long, query_id long, vec_id long, score double, scanned long"
_NOTHING = pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in _NAMES})


def nearest(rows: DataFrame, is_query: Column, k: int = 5, factor: float = FACTOR, vector: str = "embedding", vec_id: str = "vec_id", shard_rows: int = SHARD_ROWS, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows by cosine, its own row apart.

    ``is_query`` is a boolean Column over ``rows``; candidates are all rows.  Ties go to the smaller
    vec_id (nulls last).  Vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors of unlike length are never compared.  A query with fewer candidates gets
    as many rows as there are.  Rows alike in vec_id are queries and candidates of their own.  An
    empty table gives no rows; extra columns are ignored.  ``report`` is given the share of all
    (query, row) pairs that were compared, by dimension.
    """
    require(rows, vector, vec_id)
    slim = rows.select(F.col(vec_id).cast("long").alias("vec_id"), as_floats(rows, vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("v")))
    slim = slim.withColumn("dim", F.size("v"))
    out = None
    for dim, n, asked in [tuple(r) for r in slim.groupBy("dim").agg(F.count("*"), F.count_if("q")).collect()]:
        if asked:
            part = _nearest(slim.where(F.col("dim") == dim).drop("dim"), dim, n, asked, k, factor, shard_rows, report)
            out = part if out is None else out.unionAll(part)
    if out is None:
        out = slim.select(F.lit(0).cast("long").alias("query_uid"), F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).where("false")
    order = Window.partitionBy("query_uid").orderBy(F.desc(F.round("score", DIGITS)), F.asc_nulls_last("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(slim: DataFrame, dim: int, n: int, asked: int, k: int, factor: float, shard_rows: int, report: dict | None) -> DataFrame:
    """query_uid, query_id, vec_id and score of rows found for the queries of one dimension."""
    regions = min(REGIONS, -(-n // shard_rows))
    drawn = slim.orderBy(F.xxhash64("v", F.lit(3))).limit(regions * ROWS_A_REGION if regions > 1 else 1).select("v")
    sample = unit(np.array([r[0] for r in drawn.toLocalIterator()], np.float64).reshape(-1, dim))
    top = VPTree(sample, leaf_rows=ROWS_A_REGION if regions > 1 else len(sample))
    top.x = None
    kind = slim.schema["v"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(top.leaf_of(unit(matrix(part.column(3)).astype(np.float64)))), *part.columns], names=["region", "uid", "vec_id", "q", "v"])

    # ids of rows are drawn here and written once
    placed = slim.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "q", "v").mapInArrow(place, f"region long, uid long, vec_id long, q boolean, v {kind}")
    # of equal vectors no query can be given more than k, besides itself: the smallest ids stand for all
    alike = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "uid")
    placed = materialize(placed.withColumn("r", F.row_number().over(alike)).withColumn("stored", F.col("r") <= k + 1).drop("r").where("stored or q"), "placed")
    sizes = {r[0]: -(-r[1] // shard_rows) for r in placed.where("stored").groupBy("region").count().collect()}
    first = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[r] for r in sorted(sizes))]).tolist()))
    total = max(1, sum(sizes.values()))
    table = F.create_map(*[F.lit(x) for r in sizes for x in (r, F.struct(F.lit(first[r]).alias("first"), F.lit(sizes[r]).alias("shards")))]) if sizes else None
    home = F.when(table[F.col("region")].isNotNull(), table[F.col("region")]["first"] + F.pmod(F.xxhash64("uid"), table[F.col("region")]["shards"])).otherwise(0).cast("int")
    placed = placed.withColumn("shard", home)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(_Shard(group, k))], pa.binary())})

    trees = placed.where("stored").select("shard", "uid", "vec_id", "v").groupBy("shard").applyInArrow(lambda key, g: build(key, g), "shard int, tree binary")
    if total > 1:  # read for queries at home and for those that visit
        trees = materialize(trees, "trees")

    def search(queries: pa.Table, trees: pa.Table) -> pa.Table:
        if not queries.num_rows or not trees.num_rows:
            return _NOTHING
        return pickle.loads(trees.column("tree")[0].as_py()).search(queries, k, factor)

    def searched(queries: DataFrame) -> DataFrame:
        """Blocks of queries, each with the tree of the shard that they go to."""
        blocks = queries.groupBy("shard").agg(F.max("block").alias("last"))
        sent = trees.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
        return queries.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(lambda a, b: search(a, b), _FOUND)

    block = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(max(1, -(-asked // QUERY_ROWS)))).cast("int")
    ask = placed.where("q").select("shard", block.alias("block"), "uid", "vec_id", "v")
    at_home = searched(ask.withColumn("least", F.lit(float("-inf"))))
    if total > 1 or report is not None:
        at_home = materialize(at_home, "home")
    found = at_home
    if total > 1:
        known = at_home.groupBy("query_uid").agg(F.count("*").alias("met"), F.min("score").alias("kth"))
        going = ask.join(known, ask.uid == known.query_uid, "left").select("shard", "block", "uid", "vec_id", "v", F.when(F.col("met") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("least"))

        def go(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    own, least = part.column(0).to_numpy(), part.column(5).to_numpy()
                    q = unit(matrix(part.column(4)).astype(np.float64))
                    for region, who in top.within(q, _reach(least, factor)):
                        for shard in range(first.get(region, 0), first.get(region, 0) + sizes.get(region, 0)):
                            out = who[own[who] != shard]
                            if len(out):
                                there = part.take(pa.array(out))
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), shard, np.int32)), *there.columns[1:]], names=part.schema.names)

        visits = going.mapInArrow(go, f"shard int, block int, uid long, vec_id long, v {kind}, least double")
        away = materialize(searched(visits), "away")
        found = at_home.unionAll(away)
    if report is not None:
        share = (found.agg(F.sum("scanned")).first()[0] or 0) / (asked * n)
        log.info("nearest: %d dimensions, %.4f of all pairs compared", dim, share)
        report[dim] = share
    if total > 1:
        release(trees)
    return found.drop("scanned")
