"""The pipeline against a plain run of its stages."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tagweave.llm import classifier, common
from tests.llm.test_operators import SF, brute_components, brute_fingerprint, brute_lines, check_mix, check_packing, everything
from tagweave.llm import mixing


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def resemblance(a, b):
    return len(a & b) / len(a | b)


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing_sources", "best_fit_packing"]


def test_stages_one_by_one(spark):
    docs = common.table(spark, SF, "documents")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(common.durable(stage(spark, held[-1], SF), name))
        if name != "best_fit_packing":
            assert held[-1].columns == docs.columns and held[-1].dtypes == docs.dtypes
    raw, good, lined, single, mixed, packed = held

    weights = classifier.train(raw, common.table(spark, SF, "labels"))
    score = {r.doc_id: r.score for r in classifier.score(raw, weights).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, s in score.items() if s >= 0.3}
    bad = {r.doc_id for r in common.table(spark, SF, "labels").where("quality = 0").collect()}
    assert sum(d in bad for d in {r.doc_id for r in good.collect()}) <= 0.2 * max(1, len(bad))

    assert dict(everything(lined)) == dict(brute_lines(everything(good), 50))
    assert lined.where(F.col("n_chars") != F.char_length("text")).count() == 0

    rows = everything(lined)
    left = {r.doc_id for r in single.collect()}
    fps = {r.doc_id: brute_fingerprint(r.text, 5) for r in rows}
    texts = {r.doc_id: shingles(r.text) for r in rows}
    assert left <= set(brute_components(list(fps), list(fps.values())))
    for d in left:  # no link is left between documents that stay
        assert not any(e < d and ((fps[d] ^ fps[e]).bit_count() <= 4 or resemblance(texts[d], texts[e]) >= 0.8) for e in left)
    for d in set(fps) - left:  # and what goes resembles something
        assert any(e != d and ((fps[d] ^ fps[e]).bit_count() <= 4 or resemblance(texts[d], texts[e]) >= 0.8) for e in fps)

    plan = mixing.mix(mixing.sizes_and_weights(single)).collect()
    check_mix(plan)
    want = Counter({r.doc_id: r.taken // r.size for r in plan if r.taken})
    assert Counter(r.doc_id for r in mixed.collect()) == want

    check_packing(everything(mixed), packed.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "piece", "start"]
