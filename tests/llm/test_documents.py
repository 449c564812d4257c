"""SimHash, quality, mixing and packing against brute force and on odd inputs."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import mixing, packing, quality, queries, simhash
from spindrift.llm.unionfind import merge_labels

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CODER = Tokenizer.from_file(TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, times int, component_id string"


def odd_documents(spark):
    """Nulls, empty and long texts, copies, repeated rows, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog near the old river bank "
    rows = [
        (1, base * 3, "a"), (2, base * 3, "a"), (2, base * 3, "a"), (3, "", "b"), (4, None, "b"), (5, "one", None), (6, "two words", "c"),
        (7, "x " * 200_000 + "end", "a"), (None, "null id text that is alone here", "c"), (None, base * 3, None), (8, "ÉTÉ à la plage 日本   fin.", "b"), (9, " \t\n", "b"),
    ]
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", 1, "c") for i, t, s in rows], SCHEMA)


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > len(h))


@given(st.text(alphabet="aBé \t\n 日.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_local_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = [x[:600] ^ (np.uint64(1) << rng.integers(0, 63, 600, dtype=np.uint64)) for _ in range(3)]
    dense = x[0] ^ (np.uint64(1) << rng.integers(0, 12, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 400, dtype=np.uint64))
    x = np.unique(np.concatenate([x, *near, dense]))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)
    expected = merge_labels(np.arange(len(x)), a, b)
    assert (simhash.local_forest(x) == expected).all()
    nodes = simhash.build_tree(x[::3], 20)
    rows, shards = simhash.route(x, nodes)
    labels = np.arange(len(x))
    for s in np.unique(shards):
        idx = rows[shards == s]
        labels = merge_labels(labels, idx, idx[simhash.local_forest(x[idx])])
    assert (labels == expected).all()


def test_shards_stay_bounded_as_points_grow(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(simhash, "SHARD_POINTS", 64)
    monkeypatch.setattr(simhash, "FAN", 8)
    largest = []
    for n in (512, 4096, 16_384):
        x = np.unique(np.concatenate([rng.integers(0, 2**63, n // 2, dtype=np.uint64), *(x_ ^ (np.uint64(1) << rng.integers(0, 60, n // 8, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, n // 8, dtype=np.uint64)) for x_ in rng.integers(0, 2**63, 4, dtype=np.uint64))]))
        rows, parts = simhash.route(x, simhash.build_tree(np.sort(rng.permutation(x)[:1024]), simhash.leaves_for(len(x))))
        sizes = []
        for p in np.unique(parts):
            part = x[rows[parts == p]]
            tree = simhash.build_tree(np.sort(rng.permutation(part)[:1024]), simhash.leaves_for(len(part)))
            assert simhash.unpack_nodes(simhash.pack_nodes(tree)) == tree
            sizes += np.bincount(simhash.route(part, tree)[1]).tolist()
        largest.append(max(sizes))
    assert largest[-1] < 16_384 / 8


def test_two_levels_of_trees_find_the_same_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    x = np.unique(np.concatenate([x, *(x[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4))]))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)
    expected = merge_labels(np.arange(len(x)), a, b)
    monkeypatch.setattr(simhash, "SHARD_POINTS", 60)
    monkeypatch.setattr(simhash, "FAN", 6)
    prints = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(3)
    found = simhash.hamming_links(prints).collect()
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    labels = merge_labels(np.arange(len(x)), np.array([place[r.src] for r in found]), np.array([place[r.dst] for r in found]))
    assert (labels == expected).all()


def brute_components(rows):
    """{row: smallest doc_id} of documents whose fingerprints link at 2 bits."""
    prints = [slow_fingerprint(t) for _, t in rows]
    labels = np.arange(len(rows))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    if pairs:
        labels = merge_labels(labels, *map(np.array, zip(*pairs)))
    least = {}
    for (i, _), c in zip(rows, labels):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return Counter((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, labels))


def test_near_duplicates_on_odd_documents(spark):
    docs = odd_documents(spark)
    found = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert Counter(map(tuple, found.collect())) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_op4_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op4_simhash(spark, sf_dir).collect())) == brute_components(docs)


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # 3, 4 and 9 have no words; 1, 2 and a null id are copies
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 5, 6, 7, 8)] + [(True, 0)]


def test_quality_scores(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert len(held) > 30 and sum(p == q for p, q in held) / len(held) > 0.97


def plain_statistics(text):
    """The statistics of a text by plain counting."""
    words = text.split()
    if not words:
        return [0.0] * 6
    raw = text.encode("utf-8", "replace")
    marks = [b for b in raw if not (chr(b).isalpha() and b < 128 or b >= 128 or chr(b) in " \t\n\r\x0b\x0c" or chr(b) in "0123456789.,;:'\"-()?")]
    letters = [chr(b) for b in raw if b < 128 and chr(b).isalpha()]
    share = lambda part, whole: math.sqrt(min(1.0, max(0, part) / whole)) if whole else 0.0
    return [
        math.log1p(len(words)) / 10, share(len(marks) - 4, sum(chr(b) not in " \t\n\r\x0b\x0c" for b in raw)), share(sum(c.isupper() for c in letters) - len(words), len(letters)),
        share(sum(not any(c.isalnum() for c in w) for w in words) - 2, len(words)), share(sum(a == b for a, b in zip(words, words[1:])) - 1, len(words)), min(1.0, (len(set(words)) + 2) / len(words) ** 0.8),
    ]


def test_op5_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    x = {i: np.array(plain_statistics(t)) for i, t in docs.items()}
    rows = [np.array([x[i] for i, q in labels if q == c and i in docs and not held[i]]) for c in (0, 1)]
    total = len(rows[0]) + len(rows[1])
    pooled = sum(len(r) * np.cov(r.T, bias=True) for r in rows) / total

    def density(v, c):
        mixed = 0.7 * np.cov(rows[c].T, bias=True) + 0.3 * pooled
        cov = 0.8 * mixed + 0.2 * np.diag(np.diag(mixed)) + 1e-3 * np.eye(6)
        d = v - rows[c].mean(axis=0)
        return math.log((len(rows[c]) + 1) / (total + 2)) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * d @ np.linalg.solve(cov, d)

    for r in queries.op5_quality(spark, sf_dir).collect():
        odds = np.clip(density(x[r.doc_id], 1) - density(x[r.doc_id], 0), -30, 30)
        assert r.held_out == held[r.doc_id] and abs(r.score - 1 / (1 + math.exp(-odds))) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_quality_fits_on_a_bounded_sample(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    sample = quality.training_labels(labels, most=500)
    picked = {r.fit_id for r in sample.collect()}
    assert 350 < len(picked) < 650 and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in picked)
    assert picked == {r.fit_id for r in quality.training_labels(labels.repartition(7), most=500).collect()}


def test_quality_refuses_clashing_columns(spark, sf_dir):
    docs = odd_documents(spark).withColumn("length", F.lit(1)).withColumn("score", F.lit("s"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert quality.score_documents(docs, labels, keep=("doc_id", "length")).columns == ["doc_id", "length", "held_out", "score", "predicted"]
    with pytest.raises(ValueError, match="repeat"):
        quality.score_documents(docs, labels, keep=("doc_id", "score"))


def test_quality_labels_of_held_out_rows_have_no_say(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert sorted(map(tuple, quality.score_documents(docs, labels).collect())) == sorted(map(tuple, quality.score_documents(docs, turned).collect()))


def test_quality_on_odd_documents(spark, sf_dir):
    docs, labels = odd_documents(spark), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = labels.where(F.lit(False))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.score_documents(docs.where(F.lit(False)), labels).count() == 0
    ones = labels.where("quality = 1")
    assert all(0 <= r.score <= 1 for r in quality.score_documents(docs, ones).collect())


def test_clean_documents_are_kept(spark, sf_dir):
    clean = ["Hello.", "The cat sat on the mat and looked at the dog. Then it went out into the rain.", "In 2020, the total was 1,234,567 units, up 12.5% from 2019.", "Contact us at https://example.com/page?x=1 or by phone: +1 555 123 4567."]
    junk = ["spam " * 100, "word### the*** of%%% and&&& " * 30, "THIS IS ALL CAPS!! " * 20, "a | b | c | d\n" * 20]
    docs = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    both = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").unionAll(docs)
    kept = {r.doc_id for r in quality.keep_good(both, spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")).where("doc_id >= 10000000").collect()}
    assert kept == {10_000_000 + i for i in range(len(clean))}


def brute_mix(rows, budget, max_repeat):
    """rows: (key, source, tokens). The same mix by plain loops over plain bisection."""
    import hashlib

    place = lambda e, k: int(hashlib.md5(f"{mixing.SEED}|{e}|{k}".encode()).hexdigest()[:15], 16)
    tokens = defaultdict(int)
    for _, s, n in rows:
        tokens[s] += n
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())
    repeat = lambda a: max((n / total) ** a / sum((m / total) ** a for m in live.values()) * budget / n for n in live.values())
    low, high = 0.0, 1.0
    if not live or repeat(1.0) > max_repeat:
        low = high = 1.0
    elif repeat(0.0) <= max_repeat:
        low = high = 0.0
    else:
        for _ in range(mixing.HALVINGS * mixing.PASSES):
            mid = (low + high) / 2
            low, high = (low, mid) if repeat(mid) <= max_repeat else (mid, high)
    z = sum((n / (total or 1)) ** high for n in live.values())
    out = Counter()
    for s in tokens:
        mine = [(k, n) for k, t, n in rows if t == s]
        if not tokens[s]:
            out.update((k, 0) for k, _ in mine)
            continue
        target = math.floor((tokens[s] / total) ** high / z * budget + 0.5)
        epochs, rest = divmod(target, tokens[s])
        out.update((k, e) for e in range(epochs) for k, _ in mine)
        for k, n in sorted(mine, key=lambda m: (place(epochs, m[0]), m[0])):
            if n > rest:
                break
            rest -= n
            out[k, epochs] += 1
    return out, high


@pytest.mark.parametrize(("max_repeat", "share"), [(1.25, 1.0), (4.0, 1.0), (1.05, 0.7), (3.0, 2.5)])
def test_mixing_against_plain_loops(spark, sf_dir, max_repeat, share):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(str(r.doc_id), r.source, len([w for w in __import__("re").split(r"[ \t-\r]+", r.text) if w])) for r in docs.collect()]
    budget = int(share * sum(n for *_, n in rows))
    chosen, plan = mixing.mix(docs, budget, max_repeat)
    expected, alpha = brute_mix(rows, budget, max_repeat)
    got = Counter((str(r.doc_id), r.epoch) for r in chosen.collect())
    # places are 60 bits wide, so ties are out of the question; a whole block may end just at its budget
    assert got == expected
    assert abs(sum(r.weight for r in plan.collect()) - 1) < 1e-9
    assert 0 <= alpha <= 1


def test_entropy_target(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    entropy = lambda a: -sum(w * math.log(w) for w in [(n / 1000) ** a / sum((m / 1000) ** a for m in (900, 90, 10)) for n in (900, 90, 10)])
    a = mixing.bisect_exponent(sources, 1000, None, 0.8)
    assert entropy(a) >= 0.8 - 1e-6 and entropy(a + 1e-5) < 0.8
    assert mixing.bisect_exponent(sources, 1000, None, 5.0) == 0.0
    assert mixing.bisect_exponent(sources, 1000, None, 0.0) == 1.0
    with pytest.raises(ValueError):
        mixing.bisect_exponent(sources, 1000, 2.0, 1.0)


def test_mixing_on_odd_documents(spark):
    docs = odd_documents(spark)
    chosen, _ = mixing.mix(docs, max_repeat=4.0)
    assert chosen.where("n_tokens = 0").count() >= 3
    applied = mixing.apply_mix(docs, max_repeat=4.0)
    assert applied.columns == docs.columns
    assert {r.doc_id for r in applied.collect()} == {r.doc_id for r in chosen.collect()}
    empty = docs.where(F.lit(False))
    assert mixing.mix(empty)[0].count() == 0 and mixing.apply_mix(empty).count() == 0


@given(st.text(alphabet="aB'sé .,_%-\t\n 日<|>endoftx5", max_size=40))
@settings(max_examples=400, deadline=None)
def test_word_encoder_is_the_tokenizer(text):
    ids = np.frombuffer(packing.word_encoder(TOKENIZER)([text])[0], "<u2").tolist()
    assert ids == CODER.encode(text, add_special_tokens=False).ids if text else ids == []


def test_first_fit_decreasing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 3000).tolist()
    bins = packing.first_fit_decreasing(sizes, 100)
    plain: list[int] = []
    expected: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((k for k, room in enumerate(plain) if room >= sizes[i]), None)
        if at is None:
            plain.append(100)
            expected.append([])
            at = len(plain) - 1
        plain[at] -= sizes[i]
        expected[at].append(i)
    assert bins == expected
    assert [packing.cut_points(n) for n in (1, 6, 4096)] == [[1], [4, 6], [4096]]


def check_packing(docs, packed, width=4096):
    ids = [(r.doc_id, [*CODER.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs]
    wanted = Counter((i, len(x)) for i, x in ids)
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id, r.doc_tokens].append(r)
    assert set(pieces) == set(wanted)
    for (i, n), found in pieces.items():
        assert sum(r.length for r in found) == n * wanted[i, n]
        whole = [np.array(x) for j, x in ids if j == i and len(x) == n]
        for r in found:
            assert any(packing.crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in whole)
        covered = Counter(k for r in found for k in (r.start, -r.start - r.length))
        assert covered[0] == wanted[i, n]
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append(r)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    return padding / max(1, padding + sum(r.length for r in packed))


def test_op10_against_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert check_packing(docs, queries.op10_packing(spark, sf_dir).collect()) < 0.03


def test_packing_on_odd_documents(spark):
    docs = odd_documents(spark)
    check_packing(docs.collect(), packing.pack(docs, TOKENIZER).collect())
    assert packing.pack(docs.where(F.lit(False)), TOKENIZER).count() == 0
    wide = packing.pack(docs, TOKENIZER, width=64, with_ids=True, group_docs=3).collect()
    assert all(len(r.ids) == 2 * r.length and packing.crc(np.frombuffer(r.ids, "<u2")) == r.ids_crc32 for r in wide)
    check_packing(docs.collect(), wide, 64)
