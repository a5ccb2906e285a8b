"""Corpus operators against brute force, on small tables with nulls, empty and repeated texts."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import DATA
from oracle import difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe, chat, induced, media, mixing, neighbours, quality, queries, secrets, simhash, substrings, suffixes
from shelfmark.llm.induced import shared_neighbours, suffix_order

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "[\x20\x09-\x0d]+"


@pytest.fixture(scope="session")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "eps", "ζeta", "x"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = [None, "", "  \n", "one", "one two three", passage, passage, passage + " tail", "head " + passage, "a" * 700, "ab " * 300, passage[:150] + " mid " + passage]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts += ["long " + "\t".join(rng.choice(vocabulary) for _ in range(20000))]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint long").repartition(3)


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text):
    return [w for w in re.split(WORDS, text) if w]


def test_simhash(docs, texts):
    found = {r.doc_id: r for r in simhash.digests(simhash.near_duplicates(docs)).collect()}
    value = {}
    for i, t in texts.items():
        w = words(t.translate({c: c + 32 for c in range(65, 91)}))
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else [], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(h)
        value[i] = int(np.packbits(bits, bitorder="little").view("<u8")[0])
        assert found[i].fingerprint == f"{value[i]:016x}"
    label = {i: i for i in value}
    for _ in value:
        for a in value:
            for b in value:
                if (value[a] ^ value[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if all(found[i].component_id == label[i] for i in value):
            break
    assert {i: r.component_id for i, r in found.items()} == label


def test_simhash_split_trees_give_the_same_links(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 20)
    values = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 60, (15, 2))]
    rows = spark.createDataFrame(list(enumerate(dict.fromkeys(values))), "node long, f0 long")
    groups = lambda tree: {tuple(r) for r in simhash.components(simhash.links(rows, simhash.exact_blocks(), 4, tree)).collect()}
    assert groups(10**6) == groups(7)


def test_substrings(docs, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        w, gone = words(texts[i]), set()
        for p in range(len(w) - 19):
            if (k := tuple(w[p : p + 20])) in seen:
                gone.update(range(p, p + 20))
            seen.add(k)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in substrings.digests(substrings.remove_repeats(docs)).collect()} == want


@pytest.mark.parametrize("heavy", [suffixes.HEAVY, 1])
def test_suffixes(docs, texts, heavy):
    places = {}
    for i, t in texts.items():
        b = t.encode()
        for p in range(len(b) - 199):
            places.setdefault(b[p : p + 200], []).append((i, p))
    gone = {i: np.zeros(len(t.encode()), bool) for i, t in texts.items()}
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + 200] = True
    want = {}
    for i, t in texts.items():
        b, g = t.encode(), gone[i]
        want[i] = (len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.digests(suffixes.remove_repeats(docs, heavy=heavy)).collect()} == want


@pytest.mark.parametrize("memory,small", [(100, 0), (1 << 28, 1 << 15)])
def test_induced_sorting(monkeypatch, memory, small):
    monkeypatch.setattr(induced, "SMALL", small)
    rng = np.random.default_rng(1)
    for trial in range(60):
        depth, letters, n = int(rng.integers(1, 12)), int(rng.integers(1, 5)), int(rng.integers(1, 300))
        t = rng.integers(1, letters + 1, n)
        if n > 40:
            t[n // 2 : n // 2 + n // 3] = t[: n // 3]
        places = {}
        for i in range(n - depth + 1):
            places.setdefault(tuple(t[i : i + depth]), []).append(i)
        found = shared_neighbours(np.append(t, 0), letters + 1, depth, memory)
        assert {i for i in found.tolist() if i <= n - depth} == {i for v in places.values() if len(v) > 1 for i in v}


@pytest.mark.parametrize("small", [0, 20, 1 << 15])
def test_suffix_order_of_ranks_with_any_ranges(monkeypatch, small):
    monkeypatch.setattr(induced, "SMALL", small)
    rng = np.random.default_rng(2)
    for trial in range(60):
        n, letters, depth, block = int(rng.integers(1, 120)), int(rng.integers(1, 8)), int(rng.integers(2, 200)), int(rng.choice([1, 3, 10, 1000]))
        t = rng.integers(1, letters + 1, n)
        if trial % 2:
            t[n // 2 : n // 2 + n // 3] = t[: n // 3]
        t = np.append(t, 0).astype(np.int32)
        order = suffix_order(t, depth, block, 64).tolist()
        assert sorted(order) == list(range(n + 1))
        keys = [tuple(t[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys)


def test_induced_sorting_in_less_memory_than_the_shard(tmp_path):
    rng, peaks = np.random.default_rng(0), []
    for n in (1_000_000, 4_000_000):
        text = np.memmap(tmp_path / str(n), np.int16, "w+", shape=(n + 1,))
        text[:n] = rng.integers(1, 30, n)
        text[n // 2 : n // 2 + 500] = text[1000:1500]
        text[n] = 0
        tracemalloc.start()
        found = shared_neighbours(text, 258, 200, 1 << 20)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == 2 * (500 - 199)
    # The shard's tuples, queued by position and prefix, are 24 MB and the text 8 MB.
    assert peaks[1] < 20 << 20 and peaks[1] < 2 * peaks[0]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels))
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.collect())


def test_quality_without_labels(spark, docs):
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_media(spark, docs, texts, tmp_path):
    rows = {r.doc_id: r for r in media.round_trip(docs).collect()}
    for i, t in texts.items():
        payload = t.encode()
        payload += b"\0" * (max(64, -(-len(payload) // 64) * 64) - len(payload))
        r = rows[i]
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[5].media_sha256 == rows[6].media_sha256
    where = str(tmp_path / "a")
    media.store(docs.where("doc_id BETWEEN 4 AND 8").coalesce(1), where)
    spark.dataSource.register(media.ArchiveSource)
    archive = next(p for p in (tmp_path / "a").iterdir() if p.name.endswith(".archive"))
    raw = bytearray(archive.read_bytes())
    raw[60] ^= 1
    archive.write_bytes(raw)
    for size in (50, 1 << 20):
        got = spark.read.format("archive").option("range_bytes", size).load(where).collect()
        assert len(got) == 5 and sum(r.error is not None for r in got) == 1


def test_bpe_equals_library(docs, texts):
    t = Tokenizer.from_file(PATH)
    found = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    v, rng = bpe.vocabulary(PATH), random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice("the ingσΣİ1²'s<|endoftext|>é\u0301漢😀\x85\x1c") for _ in range(rng.randint(0, 14)))
        assert v.encode(s) == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_secrets(spark):
    key = "Zq8Xk2Lw9PvT4bRn7YsJ5dHf3GmC6"
    texts = [None, "", "no secrets at all", 'é password: "hunter22" and token=abc', f"secret=token: abcdef api_key = {key}", "x AKIA" + "ABCDEFGH12345678 y", "deadbeef" * 3 + " deadbeef", f"see {key} here", "password=abcdef " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus = spark.read.parquet(f"{DATA}/documents.parquet")
    model = secrets.train(corpus)
    found = {r.doc_id: r for r in secrets.digests(secrets.find(rows, model)).collect()}
    assign = re.compile(secrets.ASSIGN, re.ASCII)
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert found[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest(), t
    assert "markov:4:33" in found[7].spans
    clean = {r.doc_id: r.text for r in secrets.redact(rows, model).collect()}
    assert clean[7] == "see [SECRET] here" and clean[2] == texts[2] and clean[0] is None and "hunter22" not in clean[3]


def test_mixing_deviates_by_less_than_a_block(docs):
    for weights in (None, {"src0": 5, "src1": 2, "src2": 1}):
        rows = mixing.mix(docs, weights, block=2, period=40, bucket=5).collect()
        assert len(rows) == docs.count() and len({r.mix_position for r in rows}) == len(rows)
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
        assert len({(r.mix_slot, r.source) for r in rows}) == len({r.mix_slot for r in rows})


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16))
    v[200:260] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1020, [1.0, 2.0])]
    table = neighbours.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q in range(0, 400, 20):
        score = (v[q] * v).sum(axis=1)
        score[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(400), -score))[:20].tolist()) & set(got[q]))
    assert hit >= 0.9 * 400 and set(got) == set(range(0, 400, 20))


def test_repeated_vector_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(3)
    v, ids = rng.standard_normal((90, 8)), [i % 60 for i in range(90)]  # thirty ids twice, 0 and 20 among them
    v[60] = v[0]
    index = neighbours.index(spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(3))
    got = {}
    for r in neighbours.nearest(index, index.where("vec_id % 20 = 0"), k=89).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert index.count() == 90 and set(got) == {0, 20, 40}
    for q, found in got.items():
        wanted = []
        for own in (i for i in range(90) if ids[i] == q):
            others = sorted((-float((v[own] * v[j]).sum()), ids[j]) for j in range(90) if j != own)
            wanted += [(n, i, -s) for n, (s, i) in enumerate(others, 1)]
        assert sorted(x[:2] for x in found) == sorted(x[:2] for x in wanted)
        assert np.allclose(sorted(x[2] for x in found), sorted(x[2] for x in wanted))
    # A row's twin with the same vector is its candidate.
    assert sum(i == 0 for _, i, _ in got[0]) == 2


def test_every_code_point_encodes_as_the_library(spark):
    """Alone, between letters, before a number, and between marks that compose around it."""
    library, ours = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}1 \u00c1{c}\u0323" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    assert all(ours.encode(t) == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(points) if rng.random() < 0.5 else rng.choice("aA1 '\u0130\u03a3\u0301\u1e9e\u023a") for _ in range(rng.randrange(12)))
        assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_chat_query_equals_sql(spark):
    assert difference(queries.queries()["op10_chat_format"](spark, DATA), queries.oracle_sql()["op10_chat_format"], DATA) is None


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q [INST]", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good\\", 0.9), (1, 4, 3, "tool", None, 0.9), (2, 1, 99, None, "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    found = {(r.conv_id, r.branch): chat.parse_turns(r.formatted) for r in chat.format_paths(chat.branches(messages, 2)).collect()}
    assert found == {(1, 1): [("user", "q [INST]"), ("assistant", "good\\"), ("tool", "")], (1, 2): [("user", "q [INST]"), ("assistant", "bad")], (2, 1): [("", "orphan")]}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == substrings.remove_repeats(none).count() == suffixes.remove_repeats(none).count() == media.round_trip(none).count() == 0
    assert bpe.round_trip(none, PATH).count() == secrets.find(none).count() == mixing.mix(none).count() == simhash.drop_near_copies(none).count() == 0
    vectors = neighbours.index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.nearest(vectors, vectors).count() == 0
    assert chat.read_back(chat.format_paths(chat.branches(chat.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).count() == 0


def test_null_ids_do_not_crash(spark, docs):
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")))
    n = docs.count()
    for found in (simhash.near_duplicates(odd), substrings.remove_repeats(odd), suffixes.remove_repeats(odd), media.round_trip(odd), bpe.round_trip(odd, PATH), secrets.find(odd), mixing.mix(odd)):
        assert found.count() == n


def test_a_shard_takes_few_ranges(monkeypatch):
    """A text as long as a shard's pieces: one reduced text goes by ranges, and a pass over it takes few of them."""
    text = np.append(np.random.default_rng(7).integers(1, 60, 850_000), 0).astype(np.int16)
    text[500_000:500_900] = text[100:1000]
    sorted_, ranges = [], []
    order, sweep = induced.suffix_order, induced._sweep_ranges
    monkeypatch.setattr(induced, "suffix_order", lambda t, *a: sorted_.append(len(t)) or order(t, *a))
    monkeypatch.setattr(induced, "_sweep_ranges", lambda t, s, seeds, r, *a: ranges.append(int(r[-1]) + 1) or sweep(t, s, seeds, r, *a))
    found = induced.shared_neighbours(text, 60, 200, 256 << 10)
    assert found.tolist() == [*range(100, 801), *range(500_000, 500_701)]
    assert len(sorted_) <= 1 and max(ranges, default=0) <= 32
