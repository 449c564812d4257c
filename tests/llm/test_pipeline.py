"""The pipeline's stages, each held against brute force on its own input."""

from collections import Counter

import corpus_pipeline
from test_documents import check_packing, odd_documents, slow_fingerprint

import __spark_entry__ as entry
from spindrift.llm import mixing, quality
from spindrift.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 4
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, good), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}

    one = materialize(good(spark, docs, sf_dir))
    assert one.columns == COLUMNS
    kept = one.collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, p in scores.items() if p)

    two = materialize(dedup(spark, one, sf_dir))
    assert two.columns == COLUMNS
    prints = sorted((r.doc_id, slow_fingerprint(r.text)) for r in kept)
    group = {i: i for i, _ in prints}
    for i, p in prints:
        for j, q in prints:
            if j < i and (p ^ q).bit_count() <= 2 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(group.values()))

    three = materialize(mix(spark, two, sf_dir))
    assert three.columns == COLUMNS
    chosen, _ = mixing.mix(two)
    rows = three.collect()
    assert sum(len((r.text or "").split()) for r in rows) <= sum(len((r.text or "").split()) for r in two.collect())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in chosen.collect())

    packed = pack(spark, three, sf_dir).collect()
    assert check_packing(rows, packed) < 0.05


def test_a_mix_takes_rows_by_order_and_never_beyond_its_budget(spark):
    rows = [(i % 40, f"{'w ' * (i % 7 + 1)}t{i % 60}", "en", "ab"[i % 3 == 0], 0) for i in range(400)] + [(1, "alike in all", "en", "a", 0)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tokens = sum(len(r[1].split()) for r in rows)
    for budget in (tokens // 3, tokens, 2 * tokens):
        first, again = ([tuple(r) for r in mixing.apply_mix(d, budget, max_repeat=3.0).collect()] for d in (docs, docs.repartition(5)))
        assert Counter(first) == Counter(again) and set(first) <= set(rows)
        assert budget * 0.9 < sum(len(r[1].split()) for r in first) <= budget + 1


def test_stages_on_odd_documents(spark, sf_dir):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = materialize(out)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(docs.collect(), packed)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
