"""Embedding near-duplicates by NN-descent.

Equal vectors are one point.  Points are dealt into shards of bounded size by median trees, twice
over with trees of their own.  A shard starts every point's neighbour list from a few small random
leaves and refines it by rounds of a neighbours-of-neighbours join: the members of a point's list,
and of the lists that it stands in, are brought together, and those closer to each other than the
worst of their own lists are exchanged, until few entries change.  The lists of both dealings are
merged, and further rounds run across shards: a shard is sent the vectors of the neighbours of its
points, each once.  Entries at or above the threshold give components.

A saturated list (every entry a link) is enlarged: a link beyond it may join two components, so
saturated points are held against those of other components in their shards; and its links are
counted over its whole component, exactly and in blocks.  A bounded sample is held against all
points to audit recall; while it finds a missed link, another search with other trees is merged in.
Only points, lists and links of a shard are ever in one task.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_parallelism, materialize, release, require
from .components import connected_components
from .unionfind import merge_labels
from .vectors import as_floats, matrix, unit, usable

log = logging.getLogger(__name__)

THRESHOLD = 0.95
NEIGHBOURS = 10
#: Points of a shard, leaves of a splitting tree, and sampled rows that place each of its medians.
SHARD_ROWS = 8_192
FAN = 512
ROWS_A_LEAF = 64
#: Small random leaves of a shard from which its lists start.
SEED_TREES, SEED_ROWS = 5, 64
#: Rounds at most within a shard and across shards; a round that changes a smaller share is the last.
ROUNDS, WIDE_ROUNDS = 4, 3
LEAST_CHANGE = 0.002
#: Points of the audit, searches that it may ask for, and the recall below which the result is refused.
AUDIT_ROWS = 1_024
MOST_SEARCHES = 4
LEAST_RECALL = 0.9
BLOCK_ROWS = 512
#: Rounding of single precision; links are settled in double precision at the end.
_SLACK = 2e-6

_EDGE = "a long, b long, sim float"
_SHARD_BITS, _TASK_BITS = 42, 24


# ---- lists of one shard -------------------------------------------------------------------------


def top_lists(n: int, keep: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, cosines) of the ``keep`` nearest b of each a, nearest first; -1 and -2 where short."""
    key = a * n + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    order = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else order
    a, b, s = a[order], b[order], s[order]
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    rank = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
    ok = rank < keep
    members, cosines = np.full((n, keep), -1, np.int64), np.full((n, keep), -2.0, np.float32)
    members[a[ok], rank[ok]], cosines[a[ok], rank[ok]] = b[ok], s[ok]
    return members, cosines


def small_leaves(x: np.ndarray, rows: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Leaves of a tree that halves rows along the difference of two of them."""
    stack = [np.arange(len(x))]
    while stack:
        idx = stack.pop()
        if len(idx) <= rows:
            yield idx
            continue
        i, j = rng.choice(idx, 2, replace=False)
        order = idx[np.argsort(x[idx] @ (x[i] - x[j]), kind="stable")]
        stack += [order[: len(idx) // 2], order[len(idx) // 2 :]]


def seed_lists(x: np.ndarray, keep: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """First lists: the nearest of each row in SEED_TREES small leaves."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    for _ in range(SEED_TREES):
        for idx in small_leaves(x, SEED_ROWS, rng):
            if len(idx) > 1:
                s = x[idx] @ x[idx].T
                np.fill_diagonal(s, -2.0)
                k = min(keep, len(idx) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                found.append((np.repeat(idx, k), idx[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
    return top_lists(len(x), keep, *(np.concatenate(c) for c in zip(*found)))


def both_ways(members: np.ndarray, cosines: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, fresh): each row's list, then the nearest of those whose lists it stands in."""
    n, keep = members.shape
    a, p = np.nonzero(members >= 0)
    b, s, f = members[a, p], cosines[a, p], fresh[a, p]
    order = np.lexsort((-s, b))
    a, b, f = a[order], b[order], f[order]
    rank = np.arange(len(b)) - np.searchsorted(b, np.arange(n))[b]
    ok = rank < keep
    near, new = np.full((n, 2 * keep), -1, np.int64), np.zeros((n, 2 * keep), bool)
    near[:, :keep], new[:, :keep] = members, fresh
    near[b[ok], keep + rank[ok]], new[b[ok], keep + rank[ok]] = a[ok], f[ok]
    return near, new


def meet(x: np.ndarray, near: np.ndarray, new: np.ndarray, worst: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The neighbours-of-neighbours join: (a, b, cosine) that better the list of a, and new labels.

    Members of a row's neighbourhood are compared with each other where one of them is fresh in it.
    Links that no list has a place for still join the labels.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    for at in range(0, len(near), 2048):
        m, f = near[at : at + 2048], new[at : at + 2048]
        v = x[m]
        s = v @ v.transpose(0, 2, 1)
        some = (f[:, :, None] | f[:, None, :]) & (m[:, :, None] >= 0) & (m[:, None, :] >= 0) & (m[:, :, None] != m[:, None, :])
        h, i, j = np.nonzero(some & (s > worst[m][:, :, None]))
        found.append((m[h, i], m[h, j], s[h, i, j]))
        h, i, j = np.nonzero(some & (s >= threshold) & (labels[m][:, :, None] < labels[m][:, None, :]))
        labels = merge_labels(labels, m[h, i], m[h, j])
    return *(np.concatenate(c) for c in zip(*found)), labels


def descend(x: np.ndarray, members: np.ndarray, cosines: np.ndarray, rounds: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists after rounds of the join within one shard, and labels of the rows that links join."""
    n, keep = members.shape
    fresh = members >= 0
    a, p = np.nonzero(cosines >= threshold)
    labels = merge_labels(np.arange(n), a, members[a, p])
    for _ in range(rounds):
        near, new = both_ways(members, cosines, fresh)
        a, b, s, labels = meet(x, near, new, cosines[:, -1], labels, threshold)
        i, p = np.nonzero(members >= 0)
        before = np.sort(i * n + members[i, p])
        members, cosines = top_lists(n, keep, np.concatenate([i, a]), np.concatenate([members[i, p], b]), np.concatenate([cosines[i, p], s]))
        key = members + np.arange(n)[:, None] * n
        place = np.minimum(np.searchsorted(before, key), max(len(before) - 1, 0))
        fresh = (members >= 0) & ((before[place] != key) if len(before) else True)
        if fresh.sum() < LEAST_CHANGE * max(1, (members >= 0).sum()):
            break
    a, p = np.nonzero(cosines >= threshold)
    return members, cosines, merge_labels(labels, a, members[a, p])


def shard_lists(pid: np.ndarray, x: np.ndarray, keep: int, rounds: int, threshold: float, seed: int, starts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, cosine) of a shard's lists; those without a cosine (nan) say that links join a and b.

    Of several starts, each from leaves of its own, the lists are merged and refined once more.
    """
    order = np.argsort(pid)
    pid, x = pid[order], x[order]
    rng = np.random.default_rng([seed, int(pid[0] & 0xFFFFFFFF), len(pid)])
    found = [descend(x, *seed_lists(x, keep, rng), rounds, threshold) for _ in range(starts)]
    members, cosines, labels = found[0]
    if starts > 1:
        rows, places = zip(*(np.nonzero(m >= 0) for m, _, _ in found))
        merged = top_lists(len(x), keep, np.concatenate(rows), *(np.concatenate([f[k][r, p] for f, r, p in zip(found, rows, places)]) for k in (0, 1)))
        members, cosines, labels = descend(x, *merged, min(rounds, WIDE_ROUNDS), threshold)
        for _, _, other in found:
            labels = merge_labels(labels, np.arange(len(x)), other)
    a, p = np.nonzero(members >= 0)
    joined = np.flatnonzero(labels != np.arange(len(pid)))
    return (
        np.concatenate([pid[a], pid[joined]]),
        np.concatenate([pid[members[a, p]], pid[labels[joined]]]),
        np.concatenate([cosines[a, p], np.full(len(joined), np.nan, np.float32)]),
    )


# ---- dealing into shards ------------------------------------------------------------------------


def direction(dim: int, seed: int, node: int) -> np.ndarray:
    """The direction of a tree's node: drawn from the seed, so only medians are shipped."""
    return np.random.default_rng([seed, node]).standard_normal(dim).astype(np.float32)


def fit_medians(x: np.ndarray, leaves: int, seed: int) -> np.ndarray:
    """Medians of a complete tree over a sample, in heap order; a power of two of leaves."""
    medians = np.zeros(leaves - 1, np.float32)
    held = {0: np.arange(len(x))}
    for node in range(leaves - 1):
        idx = held.pop(node)
        d = x[idx] @ direction(x.shape[1], seed, node)
        medians[node] = np.median(d) if len(d) else 0.0
        held[2 * node + 1], held[2 * node + 2] = idx[d <= medians[node]], idx[d > medians[node]]
    return medians


def leaf_of(x: np.ndarray, medians: np.ndarray, seed: int) -> np.ndarray:
    """The leaf of each row, from 0."""
    out = np.zeros(len(x), np.int64)
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, idx = stack.pop()
        if node >= len(medians):
            out[idx] = node - len(medians)
        elif len(idx):
            right = x[idx] @ direction(x.shape[1], seed, node) > medians[node]
            stack += [(2 * node + 1, idx[~right]), (2 * node + 2, idx[right])]
    return out


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _trees(points: DataFrame, dim: int, n: int, seed: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """A top tree of at most FAN leaves and, where that is too few, a tree of each leaf's own.

    The top tree is fitted on a bounded sample here, the others on bounded samples in tasks; what is
    shipped is medians, FAN squared numbers at most.  FAN squared shards hold 2 * 10^9 distinct
    vectors; beyond that shards grow.
    """
    top = _power(min(FAN, n / SHARD_ROWS))
    if top == 1:
        return np.empty(0, np.float32), {}
    order = F.xxhash64("v", F.lit(seed))
    sample = points.select("v").orderBy(order).limit(top * ROWS_A_LEAF)
    medians = fit_medians(_single(np.array([r[0] for r in sample.toLocalIterator()]).reshape(-1, dim)), top, seed)
    below = _power(min(FAN, n / SHARD_ROWS / top))
    if below == 1:
        return medians, {}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of(_single(matrix(rows.column(0))), medians, seed)), rows.column(0)], names=["part", "v"])

    def fit(group: pa.Table) -> pa.Table:
        number = group.column("part")[0].as_py()
        own = fit_medians(_single(matrix(group.column("v"))), below, seed + 1 + number)
        return pa.table({"part": pa.array([number], pa.int64()), "medians": pa.array([own.tolist()], pa.list_(pa.float32()))})

    # a hash threshold gives each part about below * ROWS_A_LEAF rows of the sample, however many it has
    rate = min(1.0, 2.0 * top * below * ROWS_A_LEAF / n)
    drawn = points.where(F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.lit(1 << 30)) < int(rate * (1 << 30))).select("v")
    kind = points.schema["v"].dataType.simpleString()
    fitted = drawn.mapInArrow(part, f"part long, v {kind}").groupBy("part").applyInArrow(fit, "part long, medians array<float>")
    return medians, {r["part"]: np.array(r["medians"], np.float32) for r in fitted.toLocalIterator()}


def _single(x: np.ndarray) -> np.ndarray:
    return unit(x.astype(np.float64)).astype(np.float32)


def _sharder(points: DataFrame, dim: int, n: int, seed: int):
    """The shard of unit rows, from trees fitted on ``points``."""
    top, below = _trees(points, dim, n, seed)

    def shard(x: np.ndarray) -> np.ndarray:
        leaf = leaf_of(x, top, seed)
        if not below:
            return leaf
        finer = np.zeros(len(x), np.int64)
        for number in np.unique(leaf):
            here = np.flatnonzero(leaf == number)
            if number in below:
                finer[here] = leaf_of(x[here], below[number], seed + 1 + int(number))
        return leaf * FAN + finer

    return shard


def _deal(points: DataFrame, dim: int, n: int, seed: int) -> DataFrame:
    """pid, lo, m and v: the upper bits of a pid say its home shard.

    Ids are drawn by task and row, and the table is written once.
    """
    home = _sharder(points, dim, n, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = TaskContext.get().partitionId() << _TASK_BITS, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = batch.slice(start, 4096)
                own = at + count + np.arange(rows.num_rows)
                count += rows.num_rows
                if count >> _TASK_BITS or at >> _SHARD_BITS:
                    raise ValueError("too many rows or tasks for point ids: give the input more or fewer partitions")
                shards = home(_single(matrix(rows.column(2)))) << _SHARD_BITS
                yield pa.RecordBatch.from_arrays([pa.array(shards + own), *rows.columns], names=["pid", "lo", "m", "v"])

    kind = points.schema["v"].dataType.simpleString()
    return materialize(points.select("lo", "m", "v").mapInArrow(run, f"pid long, lo long, m long, v {kind}"), "dealt")


def _dealt_again(points: DataFrame, dim: int, n: int, seed: int) -> DataFrame:
    """shard, pid and v of another dealing of the same points."""
    other = _sharder(points, dim, n, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = batch.slice(start, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(other(_single(matrix(rows.column(1))))), *rows.columns], names=["shard", "pid", "v"])

    kind = points.schema["v"].dataType.simpleString()
    return points.select("pid", "v").mapInArrow(run, f"shard long, pid long, v {kind}")


def _home(column: str = "pid"):
    return F.shiftright(column, _SHARD_BITS)


# ---- lists of all points ------------------------------------------------------------------------


def _search(dealt: DataFrame, rounds: int, threshold: float, seed: int, starts: int) -> DataFrame:
    """Edges of the lists of every shard of one dealing (shard, pid, v)."""

    def run(group: pa.Table) -> pa.Table:
        a, b, s = shard_lists(group.column("pid").to_numpy(), _single(matrix(group.column("v"))), NEIGHBOURS, rounds, threshold - _SLACK, seed, starts)
        return pa.table({"a": a, "b": b, "sim": s})

    return dealt.groupBy("shard").applyInArrow(run, _EDGE)


def _best(edges: DataFrame) -> DataFrame:
    """a, b, sim and fresh of the lists: the NEIGHBOURS nearest of each a; fresh if new in this round."""
    one = edges.repartition(default_parallelism(edges.sparkSession), "a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= NEIGHBOURS).drop("r")


def _exchange(lists: DataFrame, points: DataFrame, threshold: float, held: list[DataFrame]) -> DataFrame:
    """Edges of one neighbours-of-neighbours join over all shards, with nan cosines as in shard_lists.

    A shard joins the neighbourhoods of its own points; it is sent each vector that stands in one of
    them once.  Of the lists that a point stands in the nearest count, as many as a list holds.
    """
    back = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    forward = lists.select(F.col("a").alias("host"), F.col("b").alias("member"), "fresh")
    reverse = lists.withColumn("r", F.row_number().over(back)).where(F.col("r") <= NEIGHBOURS).select(F.col("b").alias("host"), F.col("a").alias("member"), "fresh")
    around = materialize(forward.unionAll(reverse).withColumn("shard", _home("host")), "around")
    held.append(around)
    needs = around.where(F.col("shard") != _home("member")).select("shard", F.col("member").alias("pid")).distinct()
    worst = lists.groupBy("a").agg(F.when(F.count("*") == NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    rich = points.select("pid", "v").join(worst.withColumnRenamed("a", "pid"), "pid", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
    sent = rich.withColumn("shard", _home()).unionByName(needs.join(rich, "pid"))

    def run(vectors: pa.Table, around: pa.Table) -> pa.Table:
        if not around.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float32())})
        pid = vectors.column("pid").to_numpy()
        order = np.argsort(pid)
        pid, x = pid[order], _single(matrix(vectors.column("v")))[order]
        worst = vectors.column("worst").to_numpy()[order]
        host, member = (np.searchsorted(pid, around.column(c).to_numpy()) for c in ("host", "member"))
        new = around.column("fresh").to_numpy().astype(bool)
        order = np.lexsort((member, host))
        host, member, new = host[order], member[order], new[order]
        hosts, at, sizes = np.unique(host, return_index=True, return_counts=True)
        # the host itself stands in its own neighbourhood, as long since known
        near, fresh = np.full((len(hosts), sizes.max() + 1), -1, np.int64), np.zeros((len(hosts), sizes.max() + 1), bool)
        place = np.repeat(np.arange(len(hosts)), sizes), np.arange(len(host)) - np.repeat(at, sizes)
        near[place], fresh[place] = member, new
        near[:, -1] = hosts
        a, b, s, labels = meet(x, near, fresh, worst, np.arange(len(pid)), threshold - _SLACK)
        key = np.unique(a * len(pid) + b, return_index=True)[1]
        joined = np.flatnonzero(labels != np.arange(len(pid)))
        return pa.table({
            "a": np.concatenate([pid[a[key]], pid[joined]]),
            "b": np.concatenate([pid[b[key]], pid[labels[joined]]]),
            "sim": np.concatenate([s[key], np.full(len(joined), np.nan, np.float32)]),
        })

    return sent.groupBy("shard").cogroup(around.groupBy("shard")).applyInArrow(lambda a, b: run(a, b), _EDGE)


_LISTED = "not isnan(sim)"


def _labels(joins: DataFrame) -> DataFrame:
    """(pid, component) of the points that the edges join."""
    return materialize(connected_components(joins, "a", "b").withColumnRenamed("node", "pid"), "labels")


def _joins(edges: DataFrame, threshold: float) -> DataFrame:
    """Pairs of points that belong together: links, and points that links join."""
    return edges.where(F.isnan("sim") | (F.col("sim") >= threshold - _SLACK)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _enlarge(lists: DataFrame, dealings: list[DataFrame], labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that join components through links for which saturated lists had no place.

    Saturated points are held against those of other components, shard by shard of the dealings.
    """
    full = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least")).where((F.col("n") == NEIGHBOURS) & (F.col("least") >= threshold - _SLACK))
    held = materialize(full.select(F.col("a").alias("pid")).join(labels, "pid"), "saturated")
    if held.isEmpty():
        return held.select(F.col("pid").alias("a"), F.col("component").alias("b"))

    def run(group: pa.Table) -> pa.Table:
        pid, comp = (group.column(c).to_numpy() for c in ("pid", "component"))
        names, number = np.unique(comp, return_inverse=True)
        joined = np.arange(len(names))
        if len(names) > 1:
            x = _single(matrix(group.column("v")))
            order = np.argsort(number, kind="stable")
            x, number = x[order], number[order]
            for at in range(0, len(pid), 1024):
                rows = number[at : at + 1024]
                beyond = int(np.searchsorted(number, rows[0], side="right"))  # pairs are met from the smaller component
                s = x[at : at + 1024] @ x[beyond:].T
                i, j = np.nonzero((s >= threshold - _SLACK) & (rows[:, None] < number[None, beyond:]))
                joined = merge_labels(joined, rows[i], number[beyond:][j])
        moved = np.flatnonzero(joined != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[joined[moved]]})

    found = None
    for dealt in dealings:
        part = dealt.join(held, "pid").select("shard", "pid", "component", "v").groupBy("shard").applyInArrow(run, "a long, b long")
        found = part if found is None else found.unionAll(part)
    return materialize(found.distinct(), "enlarged")


def _audit(points: DataFrame, dim: int, labels: DataFrame, threshold: float, seed: int) -> tuple[float, DataFrame]:
    """(recall, missed): links of a bounded sample to all points; missed (a, b) joins two components."""
    known = points.select("pid", "v").join(labels, "pid", "left").select("pid", "v", F.coalesce("component", "pid").alias("c"))
    drawn = known.orderBy(F.xxhash64("pid", F.lit(seed))).limit(AUDIT_ROWS).collect()
    ids, comps = np.array([r[0] for r in drawn]), np.array([r[2] for r in drawn])
    x = unit(np.array([r[1] for r in drawn], np.float64).reshape(-1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                rows = batch.slice(at, 8192)
                pid, comp = rows.column(0).to_numpy(), rows.column(2).to_numpy()
                near = unit(matrix(rows.column(1)).astype(np.float64)) @ x.T >= threshold
                near &= pid[:, None] != ids[None, :]
                apart = near & (comp[:, None] != comps[None, :])
                a, b = np.nonzero(apart)
                yield pa.RecordBatch.from_arrays([pa.array([*pid[a], -1], pa.int64()), pa.array([*ids[b], -1], pa.int64()), pa.array([*[0] * len(a), int(near.sum())], pa.int64())], names=["a", "b", "links"])

    seen = materialize(known.mapInArrow(run, "a long, b long, links long"), "audit")
    links, missed = seen.agg(F.sum("links"), F.count_if(F.col("a") >= 0)).first()
    return (1.0 - missed / links if links else 1.0), seen.where("a >= 0").select("a", "b")


# ---- exact links --------------------------------------------------------------------------------


def count_block(key: np.ndarray, pid: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pid, rows linked, smallest pid joined) of pairs of a left and a right row with equal keys."""
    out: list[list[np.ndarray]] = [[], [], []]
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        a, b = part[left[part]], part[right[part]]
        own = part[np.argsort(pid[part], kind="stable")]
        names, first = np.unique(pid[own], return_index=True)
        labels, degree = np.arange(len(names)), np.zeros(len(names), np.int64)
        weight = m[own[first]]
        for at in range(0, len(a), 512):
            rows = a[at : at + 512]
            near = (x[rows] @ x[b].T >= threshold) & (pid[rows][:, None] != pid[b][None, :])
            i, j = np.nonzero(near)
            p, q = np.searchsorted(names, pid[rows[i]]), np.searchsorted(names, pid[b[j]])
            np.add.at(degree, p, weight[q])
            one_way = ~right[rows[i]] | ~left[b[j]]
            np.add.at(degree, q[one_way], weight[p[one_way]])
            labels = merge_labels(labels, p, q)
        for column, value in zip(out, (names, degree, names[labels])):
            column.append(value)
    return tuple(np.concatenate(c) for c in out)


def _exact(points: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(pid, links, root): rows that each point of a component links with, and its exact component.

    A component of no more than BLOCK_ROWS points is compared whole.  In a larger one, points within
    half the threshold's angle of its first point all link with each other and are counted without a
    comparison; only the others are compared, in pairs of blocks, with all.
    """
    found = materialize(points.select("pid", "m", "v").join(labels, "pid"), "members")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    large = materialize(sizes.where(F.col("size") > BLOCK_ROWS), "large")
    total, some_large = found.count(), not large.isEmpty()
    kind = points.schema["v"].dataType.simpleString()
    groups = max(1, -(-total // (4 * BLOCK_ROWS)))

    def count(group: pa.Table) -> pa.Table:
        comp, pid, m = (group.column(c).to_numpy() for c in ("component", "pid", "m"))
        left, right = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        ids, n, root = count_block(comp, pid, m, left, right, unit(matrix(group.column("v")).astype(np.float64)), threshold)
        return pa.table({"pid": ids, "links": n, "root": root})

    yes = F.lit(True)
    small = (found.join(large, "component", "left_anti") if some_large else found).select(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g"), "component", "pid", "m", yes.alias("left"), yes.alias("right"), "v")
    done = "pid long, links long, root long"
    counted = small.groupBy("g").applyInArrow(count, done)
    if not some_large:
        return materialize(counted, "links")

    pivots = found.join(large, "component").groupBy("component").agg(F.min_by("v", "pid").alias("pivot"))
    half = float(np.cos(np.arccos(threshold) / 2 - 1e-9))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                x, y = (unit(matrix(rows.column(c)).astype(np.float64)) for c in (3, 4))
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array((x * y).sum(axis=1) >= half)], names=["component", "pid", "m", "v", "central"])

    sides = materialize(found.join(pivots, "component").select("component", "pid", "m", "v", "pivot").mapInArrow(place, f"component long, pid long, m long, v {kind}, central boolean"), "sides")
    shares = sides.groupBy("component").agg(F.count_if("central").alias("central_n"), F.count_if(~F.col("central")).alias("outer_n"), F.sum(F.when(F.col("central"), F.col("m")).otherwise(0)).alias("weight"), F.min(F.when(F.col("central"), F.col("pid"))).alias("first"))
    shares = shares.select("component", *(F.ceil(F.col(c) / BLOCK_ROWS).cast("long").alias(c) for c in ("central_n", "outer_n")), "weight", "first")
    sides = sides.join(shares, "component")
    closed = sides.where("central").select("pid", (F.col("weight") - F.col("m")).alias("links"), F.col("first").alias("root"))
    own = F.pmod(F.xxhash64("pid", F.lit(1)), F.greatest(F.lit(1), F.when(F.col("central"), F.col("central_n")).otherwise(F.col("outer_n"))))
    sides = sides.withColumn("own", own)
    # outer blocks are numbered from 0 and met with each other once, central ones follow as partners
    last = F.col("outer_n") + F.col("central_n") - 1
    outer = sides.where("not central").select("component", "pid", "m", "v", "own", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"), "outer_n")
    inner = sides.where("central and outer_n > 0").select("component", "pid", "m", "v", (F.col("own") + F.col("outer_n")).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer_n") - 1)).alias("other"), "outer_n")
    pairs = outer.unionAll(inner).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "pid", "m", "v")
    pairs = pairs.select("component", "i", "j", "pid", "m", (F.col("own") == F.col("i")).alias("left"), (F.col("own") == F.col("j")).alias("right"), "v")
    blocks = pairs.groupBy("component", "i", "j").applyInArrow(count, done)
    parts = materialize(closed.unionAll(blocks), "parts")
    roots = connected_components(parts, "pid", "root").withColumnRenamed("component", "exact").withColumnRenamed("node", "pid")
    whole = parts.groupBy("pid").agg(F.sum("links").alias("links")).join(roots, "pid", "left").select("pid", "links", F.coalesce("exact", "pid").alias("root"))
    return materialize(counted.unionAll(whole), "links")


# ---- the operator -------------------------------------------------------------------------------


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", vec_id: str = "vec_id", rounds: int = ROUNDS, searches: int = MOST_SEARCHES, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    n_links counts the other rows whose cosine is at least ``threshold``; component_id is the
    smallest vec_id reachable by links.  Vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of unlike length, link with nothing.  Repeated rows count
    and are returned one by one; a null vec_id is kept only if nothing in its component has an id.
    An empty table gives no rows; extra columns are ignored.

    The audit's last recall, by dimension, is logged and entered in ``report``; below LEAST_RECALL a
    RuntimeError says so.
    """
    require(rows, vector, vec_id)
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), as_floats(rows, vector).alias("v")).withColumn("ok", usable(F.col("v")))
    base = materialize(base.withColumn("h", F.when(F.col("ok"), F.xxhash64("v"))), "rows")
    points = base.where("ok").groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("lo"))
    points = materialize(points.select(F.size("v").alias("dim"), "m", "lo", "v"), "points")
    solved = None
    for dim, n in [(r["dim"], r["count"]) for r in points.groupBy("dim").count().collect()]:
        part = _solve(points.where(F.col("dim") == dim).drop("dim"), dim, n, threshold, rounds, searches, {} if report is None else report)
        solved = part if solved is None else solved.unionAll(part)
    if solved is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # a point is known by its vector; those that neither link nor repeat need no join to be told
    classes = solved.withColumn("h", F.xxhash64("v"))
    good = base.where("ok").alias("r").join(classes.alias("c"), (F.col("r.h") == F.col("c.h")) & (F.col("r.v") == F.col("c.v")), "left")
    out = good.select("r.vec_id", F.coalesce("c.n_links", F.lit(0)).alias("n_links"), F.when(F.col("c.h").isNull(), F.col("r.vec_id")).otherwise(F.col("c.component_id")).alias("component_id"))
    out = out.unionAll(base.where("not ok").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _solve(found: DataFrame, dim: int, n: int, threshold: float, rounds: int, searches: int, report: dict) -> DataFrame:
    """(v, n_links, component_id) of the points of one dimension that link or stand for several rows."""
    points = _deal(found, dim, n, 101)
    home = points.select(_home().alias("shard"), "pid", "v")
    single = n <= SHARD_ROWS  # one shard holds all: it starts twice instead of being dealt twice
    joins = lists = None
    held: list[DataFrame] = []
    for attempt in range(searches):
        # every search deals by trees of its own; the first takes the home shards for one of its two
        dealings = [] if attempt and not single else [home]
        if not single:
            dealings += [_dealt_again(points, dim, n, 1_000_003 * (2 * attempt + k)) for k in range(len(dealings), 2)]
        edges = [materialize(_search(d, rounds, threshold, 17 * attempt + k, 1 + single), "edges") for k, d in enumerate(dealings)]
        pool = edges[0].unionAll(edges[-1]) if len(edges) > 1 else edges[0]
        pool = pool.where(_LISTED).withColumn("fresh", F.lit(1))
        if lists is not None:
            pool = lists.withColumn("fresh", F.lit(0)).unionByName(pool)
        lists = materialize(_best(pool), "lists")
        held += [*edges, lists]
        parts = [_joins(e, threshold) for e in edges]
        for _ in range(0 if single and not attempt else min(rounds, WIDE_ROUNDS)):
            better = materialize(_exchange(lists, points, threshold, held), "exchange")
            lists = materialize(_best(lists.withColumn("fresh", F.lit(0)).unionByName(better.where(_LISTED).withColumn("fresh", F.lit(1)))), "lists")
            held += [better, lists]
            parts.append(_joins(better, threshold))
            changed, entries = lists.agg(F.sum("fresh"), F.count("*")).first()
            log.info("near vectors: %s of %s list entries changed", changed, entries)
            if (changed or 0) < LEAST_CHANGE * (entries or 0):
                break
        for part in [*([] if joins is None else [joins]), _joins(lists.select("a", "b", "sim"), threshold)]:
            parts.append(part)
        all_joins = parts[0]
        for part in parts[1:]:
            all_joins = all_joins.unionAll(part)
        joins = materialize(all_joins.distinct(), "joins")
        for frame in held[:-1]:
            release(frame)
        held = held[-1:]
        labels = _labels(joins)
        more = _enlarge(lists, dealings, labels, threshold)
        if not more.isEmpty():
            joins = materialize(joins.unionAll(more), "joins")
            labels = _labels(joins)
        recall, missed = _audit(points, dim, labels, threshold, 7 + attempt)
        log.info("near vectors: %d dimensions, search %d, recall %.5f", dim, attempt + 1, recall)
        report[dim] = {"recall": recall, "searches": attempt + 1}
        if recall == 1.0:
            break
        joins = materialize(joins.unionAll(missed), "joins")
    else:
        if recall < LEAST_RECALL:
            raise RuntimeError(f"near vectors: recall {recall:.3f} after {searches} searches")
        labels = _labels(joins)
    counted = _exact(points, labels, threshold)
    named = points.select("pid", "lo", "m", "v").join(counted, "pid", "left").where("m > 1 or links > 0")
    named = named.withColumn("root", F.coalesce("root", "pid"))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    return named.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
