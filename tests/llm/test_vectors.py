"""Near vectors and nearest search against brute force and on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import nndescent, queries, vptree
from spindrift.llm.unionfind import merge_labels
from spindrift.llm.vectors import unit

SCHEMA = "vec_id long, embedding array<float>, label int, v string, pid int, uid int, q int, dim int, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", 1, 1, 1, 1, "c") for i, e in rows], SCHEMA)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.2, 0.0]), (4, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, None), (7, [nan, 1.0, 0.0]),
        (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]), (10, []), (11, [1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (12, [1e30, 1e29, 0.0]), (13, [-1.0, 0.0, -0.0]),
    ]


def brute(rows, threshold=0.95):
    ok = [k for k, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    labels, degree = np.arange(len(rows)), np.zeros(len(rows), int)
    for a in ok:
        for b in ok:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = unit(np.array([rows[a][1]], float))[0], unit(np.array([rows[b][1]], float))[0]
                if x @ y >= threshold:
                    degree[a] += 1
                    labels = merge_labels(labels, np.array([a]), np.array([b]))
    least = {}
    for (i, _), c in zip(rows, labels):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted((str(i), int(d), str(least.get(c)), i == least.get(c)) for (i, _), d, c in zip(rows, degree, labels))


def test_near_vectors_on_odd_rows(spark):
    got = nndescent.near_duplicates(vectors_of(spark, odd_vectors()))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got.collect()) == brute(odd_vectors())
    assert nndescent.near_duplicates(vectors_of(spark, [])).count() == 0
    assert nndescent.near_duplicates(vectors_of(spark, [(1, None)])).collect() == [(1, 0, 1, True)]


def turned(u, degrees, rng):
    """Rows ``degrees`` away from the unit rows ``u``, each in a direction of its own."""
    w = rng.standard_normal(u.shape)
    w = unit(w - (w * u).sum(axis=1, keepdims=True) * u)
    angle = np.radians(degrees)[:, None]
    return np.cos(angle) * u + np.sin(angle) * w


def truth(x, threshold=0.95):
    u = unit(np.asarray(x, float))
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    labels = merge_labels(np.arange(len(u)), *np.nonzero(s))
    return {i: (int(d), int(c), bool(c == i)) for i, (d, c) in enumerate(zip(s.sum(axis=1), labels))}


def planted(rng, dim=32, pairs=400, field=800):
    """Lone pairs near the threshold in a random field, groups, a tight and a loose large one, copies."""
    one = unit(rng.standard_normal((pairs, dim)))
    centres = unit(rng.standard_normal((14, dim)))
    groups = turned(np.repeat(centres[:12], 25, axis=0), np.full(300, 9.0), rng)
    tight = turned(np.repeat(centres[12:13], 700, axis=0), rng.uniform(1, 5, 700), rng)
    loose = turned(np.repeat(centres[13:], 600, axis=0), rng.uniform(8, 14, 600), rng)
    x = np.concatenate([one, turned(one, rng.uniform(12, 18, pairs), rng), rng.standard_normal((field, dim)), groups, tight, loose])
    x = np.concatenate([x, x[5:9], x[-3:] * 2])
    return x[rng.permutation(len(x))].astype("f4")


def solve(spark, x, **options):
    rows = vectors_of(spark, [(i, v) for i, v in enumerate(x.astype(float).tolist())]).repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(rows, **options).collect()}


def test_rounds_find_planted_links_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "SHARD_ROWS", 200)
    monkeypatch.setattr(nndescent, "FAN", 8)  # so shards take two levels of trees
    monkeypatch.setattr(nndescent, "BLOCK_ROWS", 100)
    x, report = planted(np.random.default_rng(2)), {}
    expected = truth(x)
    assert solve(spark, x, report=report) == expected
    assert report[32]["recall"] > 0.99
    # without rounds the first leaves miss links, and no later step makes up for that
    got = solve(spark, x, rounds=0, searches=1)
    wrong = [i for i in expected if got[i] != expected[i]]
    assert len(wrong) > 10


def test_rounds_find_planted_links_in_one_shard(monkeypatch):
    monkeypatch.setattr(nndescent, "SEED_TREES", 2)
    monkeypatch.setattr(nndescent, "SEED_ROWS", 40)
    x = np.unique(planted(np.random.default_rng(3), dim=64), axis=0)
    components = [c for _, c, _ in truth(x).values()]

    def wrong(rounds):
        a, b, s = nndescent.shard_lists(np.arange(len(x)), unit(x.astype(float)).astype("f4"), 10, rounds, 0.95, 1, 2)
        strong = np.isnan(s) | (s >= 0.95)
        return int((merge_labels(np.arange(len(x)), a[strong], b[strong]) != components).sum())

    assert wrong(nndescent.ROUNDS) <= 3 and wrong(0) > 10


def test_low_recall_is_refused(spark, monkeypatch):
    x = planted(np.random.default_rng(4), field=0)[:300]
    monkeypatch.setattr(nndescent, "_joins", lambda edges, threshold: edges.select("a", "b").where("false"))
    monkeypatch.setattr(nndescent, "_enlarge", lambda *_: spark.createDataFrame([], "a long, b long"))
    with pytest.raises(RuntimeError, match="recall"):
        solve(spark, x, searches=1)


def test_a_lone_link_between_saturated_groups_is_found(spark):
    # a group about 0.5 degrees, its outpost at 9; a group about 35.5, its outpost at 27: one link, 18 degrees long
    angles = np.radians([*np.linspace(0, 1, 100), 9, *np.linspace(35, 36, 100), 27])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rows = list(enumerate(x.tolist()))
    got = nndescent.near_duplicates(vectors_of(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_median_trees_deal_evenly():
    rng = np.random.default_rng(5)
    # a third of the rows lie within a degree of each other
    x = unit(np.concatenate([rng.standard_normal((4000, 16)), turned(np.repeat(unit(rng.standard_normal((1, 16))), 2000, axis=0), rng.uniform(0, 1, 2000), rng)])).astype("f4")
    medians = nndescent.fit_medians(x[rng.permutation(len(x))[:2048]], 32, 9)
    sizes = np.bincount(nndescent.leaf_of(x, medians, 9), minlength=32)
    assert sizes.sum() == len(x) and sizes.max() < 3 * len(x) / 32


@pytest.mark.parametrize("factor", [1.0, 0.8])
def test_tree_against_brute_force(factor):
    rng = np.random.default_rng(1)
    x = unit(np.concatenate([rng.standard_normal((2500, 8)), np.repeat(rng.standard_normal((1, 8)), 300, axis=0)]))
    q = unit(rng.standard_normal((200, 8)))
    got, _ = vptree.VPTree(x).query(q, 5, factor)
    expected = np.sort(q @ x.T, axis=1)[:, -5:]
    recall = np.isclose(np.sort(got, axis=1), expected, atol=1e-12).mean()
    assert recall == 1.0 if factor == 1.0 else recall >= 0.9
    few, rows = vptree.VPTree(x[:3]).query(q, 5)
    assert (rows >= 0).sum(axis=1).tolist() == [3] * 200 and np.isneginf(few).any()


def test_op2_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), unit(np.array([r.embedding for r in rows], float))
    got = {}
    for r in queries.op2_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        s[k] = -9
        top = np.lexsort((ids, -s))[:5]
        assert got[ids[k]] == [(n + 1, ids[j], round(s[j], 9)) for n, j in enumerate(top)]


def test_nearest_on_odd_rows(spark):
    df = vectors_of(spark, odd_vectors())
    found = vptree.nearest(df, F.col("vec_id").isin(1, 4, 5, 11), shard_rows=5).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, -r.score, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    # ties go to the smaller id, nulls last; 5 is zero and 11 has no vector of its length beside it
    assert by[1] == [(1, 2), (2, None), (3, 12), (4, 3), (5, 4)]
    assert len(by[4]) == 10 and set(by) == {1, 4}
    assert vptree.nearest(df.where(F.lit(False)), F.lit(True)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(7)
    one = rng.standard_normal(6)
    # one direction at sixty lengths, and vectors of zeros and ones, which tie in crowds
    rows = [(i, (one * 2.0 ** (i - 30)).tolist()) for i in range(60)] + [(100 + i, [float(i >> b & 1) for b in range(6)]) for i in range(1, 64)]
    rows += [(500 + i, (one * (i + 1)).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    x, ids = unit(np.array([v for _, v in rows])), np.array([i for i, _ in rows])
    for size in (1000, 20):
        report = {}
        got = {}
        for r in vptree.nearest(df, F.lit(True), shard_rows=size, report=report).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for k, i in enumerate(ids.tolist()):
            s = np.round(x @ x[k], 12)
            s[k] = -9
            assert got[i] == ids[np.lexsort((ids, -s))[:5]].tolist()
        assert got[0] == [1, 2, 3, 4, 5] and 0 < report[6] <= 1.1


def test_shards_and_branches_are_pruned(spark):
    rng = np.random.default_rng(8)
    x = turned(np.repeat(unit(rng.standard_normal((40, 8))), 100, axis=0), rng.uniform(0, 4, 4000), rng)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    report = {}
    found = vptree.nearest(df, F.col("vec_id") % 40 == 0, shard_rows=500, report=report).collect()
    s = x[::40] @ x.T
    s[np.arange(100), np.arange(100) * 40] = -9
    expected = {(q * 40, r + 1): i for q, row in enumerate(np.argsort(-s, axis=1)[:, :5].tolist()) for r, i in enumerate(row)}
    assert {(r.query_id, r.rank): r.vec_id for r in found} == expected and report[8] < 0.3


def test_op1_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    u = unit(np.array([e for _, e in rows], float))
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    labels = merge_labels(np.arange(len(u)), *np.nonzero(s))
    ids = np.array([i for i, _ in rows])
    least = {c: ids[labels == c].min() for c in set(labels.tolist())}
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries.op1_near_vectors(spark, sf_dir).collect()} == {i: (int(d), int(least[c])) for i, d, c in zip(ids.tolist(), s.sum(axis=1), labels.tolist())}
