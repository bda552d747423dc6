"""The pipeline's stages against plain versions, each on what the stage before has kept."""

import numpy as np

import corpus_pipeline
from auditlake.llm import language
from helpers import contamination, jaccard_components, quality_verdict
from test_language_quality import plain_code_bits
from test_packing import check


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "decontamination", "best_fit_packing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf_dir).cache()
        before, after = {r.doc_id: r.text for r in held.collect()}, out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            kept = {r.doc_id for r in after}
            assert len(kept) == len(after) and kept <= set(before)
        if name == "language_id":
            trees = language.train(held)
            for d, t in before.items():
                if len(t or "") > 5_000:
                    continue
                bits, size = plain_code_bits(trees, t or "")
                good = any(c.isalpha() for c in t or "") and 1 / np.exp2(bits.min() - bits).sum() >= 0.5 and bits.min() / max(size, 1) <= language.MOST_BITS
                assert (d in kept) == good
            assert len(kept) > 0.97 * len(before)
        elif name == "quality_rules":
            assert kept == {d for d, t in before.items() if quality_verdict(t)}
        elif name == "near_duplicates":
            assert kept == {d for d, (_, c) in jaccard_components(before.items(), 5, 80).items() if d == c}
        elif name == "decontamination":
            bad = set()
            for d, t in before.items():
                n, hit, _ = contamination(t, items)
                if hit and 20 * hit >= n:
                    bad.add(d)
            assert kept == set(before) - bad
        else:
            check(after, before.items())
        held = out


def test_edges(spark, sf_dir, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        held = docs
        for _, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, sf_dir)
        held.collect()
