"""Ids pass through the text operators as they are: nulls beside ids that a float cannot hold."""

from shelfmark.llm import quality, simhash, substrings, suffixes


def test_null_and_large_ids(spark):
    ids = [None, 2**60 + 1, 2**60 + 3, -5]
    docs = spark.createDataFrame([(i, f"some words of text {n} " * 20) for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    for found in (quality.score(docs, model), simhash.fingerprints(docs), substrings.remove_repeats(docs), suffixes.remove_repeats(docs)):
        assert {r.doc_id for r in found.collect()} == set(ids)
