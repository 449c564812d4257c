"""SimHash near-duplicates: 64-bit fingerprints joined within a Hamming radius by VP trees.

Fingerprints are collapsed to distinct values first, so thousands of copies are one point.  Vantage-point
trees over bounded samples deal the distinct fingerprints into shards, in two levels where there
are many.  At a node
with vantage ``v`` and radius ``mu``, a point at distance ``d <= mu`` lives on the left, others on
the right.  Two points within ``r`` bits differ by at most ``r`` in their distances to ``v``, so a
left point can have a partner on the right only when ``d > mu - r``: just those are copied to the
right as visitors.  Every linked pair thus meets in some shard, and shards search exactly, by a
local VP tree of the same form.  A shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_parallelism, free_name, materialize, require, words_text
from .components import connected_components
from .unionfind import merge_labels

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Leaves of a routing tree at most, sampled rows that place each, and points a shard should hold.
FAN, ROWS_A_LEAF = 512, 128
SHARD_POINTS = 8_192
#: Below this many points a local search compares all of them.
LEAF_POINTS = 384
_CHUNK = 32_768
_BYTE_PLACE = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text.

    ASCII letters are lower-cased, words split at ASCII white space; each run of ``shingle_words``
    words (all words, where there are fewer) is hashed by XXH64.  A bit is 1 if set in over half
    of the hashes.  A text without words has fingerprint 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = len(ends)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        raw = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8) + _BYTE_PLACE
        ones += (np.bincount(raw.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``out`` (the fingerprint as a signed long); null text counts as empty."""
    require(docs, text, *keep)
    schema = docs.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], out])

    raw = words_text(F.col(text)).cast("binary").alias(free_name(docs, "raw"))
    return docs.select(*keep, raw).mapInArrow(run, schema)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
    """The best of a few vantages: (vantage, mu, distances); None when no split makes progress."""
    best = None
    for _ in range(6):
        vantage = points[rng.integers(len(points))]
        d = np.bitwise_count(points ^ vantage).astype(np.int16)
        low = int(np.median(d))
        for mu in range(low - 1, low + 2):
            left = int((d <= mu).sum())
            right = int((d > mu - radius).sum()) if left < len(points) else len(points)
            if 0 < left < len(points) and right < len(points):
                cost = max(left, right)
                if best is None or cost < best[0]:
                    best = cost, vantage, mu, d
        if best is not None and best[0] <= 0.7 * len(points):
            break
    return best and best[1:]


def build_tree(sample: np.ndarray, leaves: int, radius: int = RADIUS) -> list[tuple]:
    """Nodes ``(vantage, mu, left, right)`` or ``(shard,)`` of a tree over a fingerprint sample."""
    nodes: list[tuple] = [()]
    rng = np.random.default_rng(7)
    least = max(8, len(sample) // max(leaves, 1))
    stack, shards = [(0, sample)], 0
    while stack:
        at, part = stack.pop()
        found = _split(part, radius, rng) if len(part) > least else None
        if found is None:
            nodes[at] = (shards,)
            shards += 1
            continue
        vantage, mu, d = found
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (int(vantage), mu, left, right)
        stack += [(left, part[d <= mu]), (right, part[d > mu])]
    return nodes


def leaves_for(points: int, fan: int | None = None) -> int:
    """Leaves of a tree that deals so many points into shards, as far as one tree does."""
    return max(1, min(fan or FAN, -(-points // SHARD_POINTS)))


def pack_nodes(nodes: list[tuple]) -> list[int]:
    """A tree as whole numbers, four a node; fingerprints as signed ones."""
    flat: list[int] = []
    for node in nodes:
        flat += [node[0] - (1 << 64) if node[0] >= 1 << 63 else node[0], *node[1:]] if len(node) == 4 else [node[0], -1, -1, -1]
    return flat


def unpack_nodes(flat: list[int]) -> list[tuple]:
    rows = [flat[i : i + 4] for i in range(0, len(flat), 4)]
    return [(r[0],) if r[1] < 0 and r[2] < 0 else (r[0] % (1 << 64), *r[1:]) for r in rows]


def route(points: np.ndarray, nodes: list[tuple], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row index, shard) for the home shard of each point and each shard that it visits."""
    rows, shards = [], []
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if len(node) == 1:
            rows.append(idx)
            shards.append(np.full(len(idx), node[0], np.int32))
            continue
        vantage, mu, left, right = node
        d = np.bitwise_count(points[idx] ^ np.uint64(vantage)).astype(np.int16)
        stack += [(left, idx[d <= mu]), (right, idx[d > mu - radius])]
    return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(shards or [np.empty(0, np.int32)])


def local_forest(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct points: the index of the smallest point of each one's component of links."""
    labels = np.arange(len(points))
    rng = np.random.default_rng(11)
    stack = [labels]
    while stack:
        idx = stack.pop()
        part = points[idx]
        found = _split(part, radius, rng) if len(idx) > LEAF_POINTS else None
        if found is not None:
            _, mu, d = found
            stack += [idx[d <= mu], idx[d > mu - radius]]
            continue
        step = max(1, 4_000_000 // max(len(idx), 1))
        for at in range(0, len(idx), step):
            near = np.bitwise_count(part[at : at + step, None] ^ part[None, at:]) <= radius
            a, b = np.nonzero(near)
            a, b = a + at, b + at
            keep = a < b
            labels = merge_labels(labels, idx[a[keep]], idx[b[keep]])
    return labels


def hamming_links(prints: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) that span the components of the distinct fingerprints in ``fp``.

    Two fingerprints link when they differ in at most ``radius`` bits.  No candidate is capped.  A
    tree over a bounded sample deals the points into at most FAN parts, visitors among them; a part
    that holds more than a shard is dealt on by a tree of its own, fitted in a task on a bounded
    sample of the part.  So shards stay bounded up to FAN squared of them, and the trees that are
    shipped are FAN squared nodes at most.
    """
    points = prints.select(F.col(fp).alias("fp"))
    n = points.count()
    leaves = leaves_for(n)
    drawn = points.orderBy(F.xxhash64("fp", F.lit(3))).limit(max(1024, leaves * ROWS_A_LEAF))
    sample = np.array([r[0] for r in drawn.toLocalIterator()], dtype=np.int64).view(np.uint64)
    nodes = build_tree(np.sort(sample), leaves, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, shards = route(found, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int64)), pa.array(found[rows].view(np.int64))], names=["shard", "fp"])

    def search(group: pa.Table) -> pa.Table:
        found = np.unique(group.column("fp").to_numpy().view(np.uint64))
        labels = local_forest(found, radius)
        linked = np.flatnonzero(labels != np.arange(len(found)))
        ends = found.view(np.int64)
        return pa.table({"src": ends[linked], "dst": ends[labels[linked]]})

    dealt = points.mapInArrow(deal, "shard long, fp long")
    if n > FAN * SHARD_POINTS:
        dealt = _deal_on(dealt, radius)
    return dealt.groupBy("shard").applyInArrow(search, "src long, dst long")


def _deal_on(dealt: DataFrame, radius: int) -> DataFrame:
    """(shard, fp) of parts that are dealt on, each by a tree of its own."""
    sizes = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    fan, rows = FAN, ROWS_A_LEAF

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        number = key[0].as_py()
        sample = np.sort(group.column("fp").to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([number], pa.int64()), "nodes": pa.array([pack_nodes(build_tree(sample, leaves_for(sizes[number], fan), radius))], pa.list_(pa.int64()))})

    # of each part a share that gives its leaves ROWS_A_LEAF rows
    rates = F.create_map(*[F.lit(x) for s, size in sizes.items() for x in (s, min(1.0, leaves_for(size, fan) * rows / size))])
    drawn = dealt.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30)) < rates[F.col("shard")] * F.lit(float(1 << 30)))
    below = {r["shard"]: unpack_nodes(r["nodes"]) for r in drawn.groupBy("shard").applyInArrow(lambda k, g: fit(k, g), "shard long, nodes array<long>").toLocalIterator()}

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, found = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for number in np.unique(part).tolist():
                here = found[part == number]
                rows, shards = route(here, below.get(number, [(0,)]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(number * (1 << 32) + shards.astype(np.int64)), pa.array(here[rows].view(np.int64))], names=["shard", "fp"])

    return dealt.mapInArrow(again, "shard long, fp long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (doc_id among them), ``fp`` and ``component_id`` for every document.

    component_id is the smallest doc_id reachable by links of at most ``radius`` bits.  Null and
    word-free texts share fingerprint 0 and link like any other.  A null doc_id takes the smallest
    doc_id of its component (null if the component has none).  Repeated rows each get a row.  An
    empty table gives no rows; extra columns are ignored.
    """
    slim = materialize(fingerprints(docs, keep=keep), "prints")
    points = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("lo")), "points")
    spread = points.repartition(default_parallelism(docs.sparkSession), "fp")
    found = connected_components(hamming_links(spread, radius=radius))
    labelled = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("lo").alias("component_id"))
    classes = labelled.join(least, "component").select("fp", "component_id")
    return slim.join(classes, "fp").select(*keep, "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group, with the columns of ``docs``.

    The smallest doc_id stays (nulls last); among rows that share it the smallest text hash, and one
    of rows alike in both.  Documents without a near duplicate always stay.
    """
    th, ki, kh, n = (free_name(docs, stem) for stem in ("text_hash", "kept_id", "kept_hash", "kept_times"))
    keyed = docs.withColumn(th, F.xxhash64(words_text(F.col("text"))))
    found = near_duplicates(keyed.select("doc_id", "text", th), radius, ("doc_id", th))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(th).alias("h"))
    group = F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull().alias("o")
    best = found.groupBy(*group).agg(F.min(order).alias("k")).select(F.col("k.i").alias(ki), F.col("k.h").alias(kh)).distinct()
    times = found.groupBy("doc_id", th).agg(F.count("*").alias(n))
    kept = materialize(best.join(times, best[ki].eqNullSafe(times.doc_id) & (best[kh] == times[th])).select(ki, kh, n), "kept")
    joined = keyed.join(kept, keyed.doc_id.eqNullSafe(kept[ki]) & (keyed[th] == kept[kh]))
    single = joined.where(F.col(n) == 1).select(*docs.columns)
    again = joined.where(F.col(n) > 1).dropDuplicates([th, ki]).select(*docs.columns)
    return single.unionAll(again)
