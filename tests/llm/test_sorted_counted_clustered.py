"""Exact duplicates, collocations and clustering against plain programs, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from oracle import difference
from pyspark.sql import functions as F

from shelfmark.llm import centroids, exact, phrases, queries

NEW = ["op11_phrase_collocations", "op12_exact_dedup", "op13_centroid_clustering"]


@pytest.mark.parametrize("name", NEW)
def test_sql(spark, name):
    assert difference(queries.queries()[name](spark, DATA), queries.oracle_sql()[name], DATA) is None


# --- exact duplicates


def plain_groups(rows, best=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for i, t in rows:
        ids = groups[t or ""]
        keep = best((x for x in ids if x is not None), default=None)
        out[(i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups_against_a_dictionary(spark, keep):
    random.seed(3)
    head = "the same opening of many texts, longer than the head that decides a row's place; "
    texts = [None, "", " ", "a", "A", "é", "x" * 300_000, *(head + str(n) for n in range(40))]
    rows = [(random.randrange(200), random.choice(texts)) for _ in range(500)]
    rows += [(1000 + i, "hot") for i in range(600)] + [(None, "hot"), (None, "no id"), (None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = Counter(map(tuple, exact.groups(docs, keep=keep).collect()))
    assert found == plain_groups(rows, {"max": max, "min": min}[keep])


def test_hot_text_is_cut_into_slots(spark):
    """The sort's largest task holds a small part of a text that half of all rows have."""
    docs = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    parts = []
    judged = exact.stored

    def seen(df, purpose, *a):
        if purpose == "judged":
            parts.extend(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())
            assert "ENSURE_REQUIREMENTS" not in df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("BroadcastExchange")[0].split("REPARTITION_BY_NUM")[0]
        return judged(df, purpose, *a)

    exact.stored = seen
    try:
        found = exact.groups(docs).where("kept").count()
    finally:
        exact.stored = judged
    assert found == 2001
    assert len(parts) > 1 and max(parts) < 2000


def test_exact_normalised_and_whole_rows(spark):
    rows = [(1, " A b ", "x", 1), (2, "a B", "y", 2), (3, None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, row int")
    kept = exact.drop_copies(docs, keep="min", normalise=lambda c: F.lower(F.trim(c)))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [rows[0], rows[2]]
    assert exact.groups(docs.limit(0)).collect() == []
    assert exact.drop_copies(docs.limit(0)).columns == docs.columns


# --- collocations


def plain_collocations(rows, threshold, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    out = []
    for (lang, p), a in found.items():
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(lang == l2 and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for (l2, q), b in found.items())
        if not inside:
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


def test_collocations_against_counting_everything(spark):
    random.seed(5)
    words = ["alpha", "Beta", "é", "d\x00", "e", " ", "日本"]
    texts = ["".join(random.choice(words) + random.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(random.randrange(60))) for _ in range(120)]
    rows = [(random.choice(["en", "fr", "", None, "und"]), t) for t in texts] + [("en", None), (None, ""), ("en", "one two three four five " * 400), ("en", "x" * 50_000), *[("fr", "Red Wine and cheese")] * 90]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("mine")).withColumn("a", F.lit(1)).repartition(3)
    for threshold in (3, 30):
        counted = phrases.counts(docs, threshold=threshold)
        found = phrases.collocations(counted, top=40)
        assert sorted(map(tuple, found.collect())) == plain_collocations(rows, threshold, 40)
    assert phrases.collocations(phrases.counts(docs.limit(0))).collect() == []


def test_counts_are_right_when_summaries_are_full_and_filters_saturated(spark):
    """The least capacity makes counters go; a filter of few bits lets nearly all through. Counts stay the same."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = sorted(map(tuple, phrases.counts(docs).collect()))
    rows = docs.select("lang", "text")
    _, told = phrases.filters(rows, 1, slack=1)
    assert any(t["lost"] for t in told) and all(t["lost"] < phrases.THRESHOLD for t in told)
    assert sorted(map(tuple, phrases.counts(docs, slack=1).collect())) == own
    assert sorted(map(tuple, phrases.counts(docs, bits=1 << 10).collect())) == own


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << 60, 20_000), np.repeat(rng.integers(0, 1 << 60, 50), 30)]).astype(np.uint64)
    rng.shuffle(values)
    summary = phrases.Summary(len(values) // 30 + 1)
    for part in np.array_split(values, 40):
        summary.add(*np.unique(part, return_counts=True))
    left = summary.survivors(30)
    distinct, counts = np.unique(values, return_counts=True)
    assert set(distinct[counts >= 30]) <= set(left)
    assert summary.lost < 30 and len(summary.values) <= summary.capacity


def test_scores_beyond_64_bits(spark):
    a = 5 * 10**12
    rows = [("en", 0, "", 9 * 10**18), ("en", 1, "x", a + 7), ("en", 1, "y", 2 * a), ("en", 2, "x y", a)]
    found = phrases.collocations(spark.createDataFrame(rows, "lang string, k int, phrase string, a long")).collect()
    assert [tuple(r) for r in found] == [("en", 1, "x y", a, a + 7, 2 * a, 9 * 10**18, 2000000 * a // (3 * a + 7))]


# --- clustering


def plain_clusters(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [v for _, v in first]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((distance(v, m), c) for c, m in enumerate(means)) for _, v in kept]
    for _ in range(rounds):
        near = [c for _, c in assign()]
        for c in range(len(means)):
            own = [v for (_, v), n in zip(kept, near) if n == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own)]
    last = assign()
    inertia = Counter()
    for d, c in last:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, last))


@pytest.mark.parametrize("dim,block", [(64, 37), (3, 50)])
def test_clusters_against_a_plain_program(spark, dim, block):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(150, dim)))]
    rows += [(900 + i, rows[5][1]) for i in range(60)] + [(5, rows[6][1]), (None, rows[7][1]), (1, None), (2, [0.0] * (dim - 1)), (3, [None] + [0.0] * (dim - 1)), (4, [float("nan")] * dim), (6, [float("-inf")] * dim), (8, [0.0] * dim), (9, [0.0] * dim)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("mine")).repartition(3)
    members, means, scanned = centroids.cluster(table, dim=dim, block=block)
    assert Counter(map(tuple, centroids.digests(members, means).collect())) == plain_clusters(rows, dim=dim)
    assert scanned[0] == 214 and sum(scanned[1:]) < 214 * (len(scanned) - 1)  # bounds save scans


def test_few_equal_and_no_vectors(spark):
    one = [0.5] * 64
    rows = [(1, one), (2, one), (3, [-0.25] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    members, means, _ = centroids.cluster(table)
    assert Counter(map(tuple, centroids.digests(members, means).collect())) == plain_clusters(rows)
    members, means, scanned = centroids.cluster(table.limit(0))
    assert centroids.digests(members, means).collect() == [] and scanned == []


def test_ties_and_wide_components(spark):
    rows = [(i, [x] + [0.0] * 63) for i, x in enumerate([-8000.0, -4000.0, 0.0, 4000.0, 8000.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    members, means, _ = centroids.cluster(table, block=7)
    assert Counter(map(tuple, centroids.digests(members, means).collect())) == plain_clusters(rows)
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>"))
