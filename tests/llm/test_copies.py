"""Near copies against brute force: every pair of similarity 0.8 or more is linked, and nothing else goes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.llm import common, components, copies


def _shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def _kept(rows):
    """Ids that stay, by links between all pairs."""
    sets, label = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 9 * len(x & sets[j]) >= 4 * (len(x) + len(sets[j])):
                label[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(r for i, r in enumerate(rows) if r[0] == least[top(i)])


def test_all_pairs_and_no_others(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", None, " \n", "one", "One", "one two", "one two three four"]
    texts += [" ".join(word() for _ in range(6)) for _ in range(400)]
    for n in (8, 10, 24, 104):
        for _ in range(60):
            w = [word() for _ in range(n)]
            other = list(w)
            for _ in range(rng.randrange(1, 3)):
                other[rng.randrange(n)] = word()
            texts += [" ".join(w), " ".join(w + [word()]), " ".join(other), " ".join(w[:-1])]
    passage = [word() for _ in range(60)]  # a large group around 0.8, and one of texts that share a passage alone
    for _ in range(150):
        w = list(passage)
        w[rng.randrange(60)] = word()
        texts += [" ".join(w), " ".join(passage[:30] + [word() for _ in range(20)])]
    rng.shuffle(texts)
    rows = [(i, t or "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.text or "") for r in copies.drop_near_copies(docs).collect()) == _kept(rows)


def test_shared_and_null_ids(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (2, text), (2, "another text that nobody else has at all"), (None, text), (9, ""), (10, "six words that nobody else has")]
    left = copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=repr) == sorted((r for r in rows if r != (2, text)), key=repr)


def test_blocks_of_open_nodes_against_all_pairs(spark, monkeypatch):
    """Many sets that share shingles and are mostly unlike, in blocks of a few: the groups of brute force."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    line = [f"line{i}" for i in range(40)]
    texts = [" ".join(line + rng.sample(words, rng.choice([4, 5, 30]))) for _ in range(70)] + [" ".join(line + words[i : i + 3]) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(copies, "BLOCK", 9)
    monkeypatch.setattr(copies, "HUBS", 1)
    found = {r.doc_id: r.copy_of for r in copies.near_copies(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert found == dict(enumerate(label)) and 1 < len(set(label)) < len(texts)


def test_frequent_shingles_are_counted_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([copies.OFTEN])], names=["shingle", "n"])

    monkeypatch.setattr(copies, "_often", sizes)
    value, _ = copies.frequent(spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))
    assert 0 < value.max() <= 2000


def test_a_sieve_parts_rows_and_loses_no_key(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    keys = rows.where("id % 9 = 0").select("id", "text")
    held = common.sieve(keys, F.col("id"), F.col("text"))
    among, others = ({r.id for r in common.sifted(rows, held, F.col("id"), F.col("text"), among=a).collect()} for a in (True, False))
    assert among | others == set(range(20_000)) and not among & others
    assert set(range(0, 20_000, 9)) <= among and len(among) < 2400


def test_documents_that_are_no_copies_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"{i} six words that nobody else has") for i in range(60)] + [(100 + i, f"{i} six words that nobody else has") for i in range(6)], "doc_id long, text string")
    at = []
    had = copies.sifted

    def sifted(rows, held, *key, among=True):
        out = had(rows, held, *key, among=among)
        at.append((among, out.count()))
        return out

    copies.sifted = sifted
    try:
        assert copies.drop_near_copies(docs).count() == 60
    finally:
        copies.sifted = had
    assert at[-2][1] + at[-1][1] == 66 and dict(at[-2:])[True] < 20


def test_long_unlike_sets_are_told_apart_by_their_bits(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2500)) for _ in range(8)]
    rows = [r.asDict() for r in spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, text_hash long").mapInArrow(copies._marks, "doc_id long, text_hash long, node long, n int, f0 long, bits binary").collect()]
    pairs = pa.RecordBatch.from_pylist([{"a": x["node"], "b": y["node"], "n": x["n"], "m": y["n"], "x": bytes(x["bits"]), "y": bytes(y["bits"])} for x in rows for y in rows if x["node"] < y["node"]])
    assert sum(b.num_rows for b in copies._near_enough([pairs])) == 0


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(components, "cut", lambda df, parts=None: seen.append(common.cut(df, parts)) or seen[-1])
    links = spark.range(40).select("id", (F.col("id") + 1).alias("b")).toDF("a", "b")
    assert {r.label for r in components.components(links, 2).collect()} == {0}
    assert seen and all(df.rdd.getNumPartitions() <= 2 for df in seen)


def _made_up(n, words, seed=3):
    rng = random.Random(seed)
    return pa.record_batch([pa.array(range(n)), pa.array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)])], names=["doc_id", "text"])


def test_prefixes_fill_all_buckets_alike():
    none = np.zeros(0, np.uint64)
    for value, times in ((none, none.astype(np.int64)), (np.array([5], np.uint64), np.array([20]))):
        values = np.concatenate([v for _, _, v in copies._prefixes(value, times)([_made_up(200, 300)])])
        held = np.bincount((values >> np.uint64(60)).astype(np.int64), minlength=16)
        assert held.max() < 1.3 * held.mean() and held.min() > 0.7 * held.mean()


def test_a_step_over_texts_takes_little_memory():
    texts = _made_up(250, 550)
    assert 900_000 < texts.nbytes < 1_200_000
    marked = texts.append_column("text_hash", pa.array(range(250)))
    none = np.zeros(0, np.uint64)
    for run in (lambda: copies._marks([marked]), lambda: copies._often([texts]), lambda: copies._prefixes(none, none.astype(np.int64))([texts]), lambda: copies._whole([texts])):
        list(run())  # tables of powers are made
        tracemalloc.start()
        for _ in run():
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 16e6
