"""The pipeline's stages against brute force on the smallest tables."""

import re

from conftest import DATA

import corpus_pipeline
from shelfmark.llm import quality, secrets


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    docs = corpus_pipeline.quality_filter(spark, docs, DATA)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {i for i, p in scores.items() if p}
    kept = {r.doc_id: r.text for r in docs.collect()}
    docs = corpus_pipeline.near_dedup(spark, docs, DATA)
    left = {r.doc_id for r in docs.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept.items() for w in [t.lower().split()]}
    for a in kept:
        for b in kept:
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                assert b not in left
    gone = [i for i in kept if i not in left]
    assert all(any(j != i and len(shingles[i] & shingles[j]) >= 0.4 * len(shingles[i] | shingles[j]) for j in kept) for i in gone)
    docs = corpus_pipeline.secret_removal(spark, docs, DATA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(texts) == left
    assert not any(re.search(secrets.ACCESS + "|" + secrets.HEX, t) for t in texts.values())
    assert sum(t != before[i] for i, t in texts.items()) < 0.1 * len(texts)
    mixed = corpus_pipeline.mixture(spark, docs, DATA)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == left
    assert corpus_pipeline.encoding(spark, mixed, DATA).count() == len(left)
