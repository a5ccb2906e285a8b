"""What every corpus operator does with clashing column names, nulls, empty and repeated rows, ties, and empty tables."""

import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import bpe, chat, copies, media, mixing, neighbours, quality, secrets, simhash, substrings, suffixes
from shelfmark.llm.common import word_bounds

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use inside, as further columns of the user's.
NAMES = "row hash bucket rank n k before first last slots slot share period blocks j i spans base own own_hash later text_hash node label f0 fingerprint component_id values ids anchors anchor piece edges edge start words windows score held_out predicted buckets counts input_ids n_tokens gone copy_of _gone _hash _text _base _spans _bucket _rank _s _b _source _before mix_share chars reach".split()
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


@pytest.fixture(scope="module")
def plain(spark):
    texts = [None, "", " \n", "one", PASSAGE, PASSAGE, PASSAGE + " tail", "password = hunter22 and more", "x" * 500, "ab " * 200, "é " * 150]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in NAMES if n not in plain.columns))


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(docs, labels)


@pytest.fixture(scope="module")
def table(spark):
    return secrets.train(spark.read.parquet(f"{DATA.replace("0.001", "0.1")}/documents.parquet"))


def rows_of(df, columns):
    return Counter(map(repr, df.select(*columns).collect()))


OPERATORS = {
    "op1": lambda d, m, t: simhash.digests(simhash.near_duplicates(d)),
    "op2": lambda d, m, t: substrings.digests(substrings.remove_repeats(d)),
    "op3": lambda d, m, t: quality.score(d, m),
    "op4": lambda d, m, t: suffixes.digests(suffixes.remove_repeats(d)),
    "op5": lambda d, m, t: media.round_trip(d),
    "op6": lambda d, m, t: bpe.round_trip(d, PATH),
    "op7": lambda d, m, t: secrets.digests(secrets.find(d, t)),
    "op8": lambda d, m, t: mixing.mix(d, block=2),
    "keep_good": lambda d, m, t: quality.keep_good(d, m),
    "drop_near_copies": lambda d, m, t: simhash.drop_near_copies(d),
    "redact": lambda d, m, t: secrets.redact(d, t),
    "encode": lambda d, m, t: bpe.encode(d, PATH),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(plain, clashing, model, table, name):
    run = OPERATORS[name]
    own = run(plain, model, table)
    found = run(clashing, model, table)
    assert rows_of(found, own.columns) == rows_of(own, own.columns)
    if name in ("op8", "keep_good", "drop_near_copies", "redact"):  # these keep the user's columns
        assert all(str(r[n]) == f"{n}-{r.doc_id}" for r in found.collect() for n in NAMES if n not in plain.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_null_columns(plain, model, table, name):
    run = OPERATORS[name]
    assert run(plain.limit(0), model, table).count() == 0
    nothing = plain.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in plain.schema))
    assert run(nothing, model, table).count() in (nothing.count(), 0)  # keep_good may reject a text without words


def test_repeated_rows_have_equal_results(plain, model, table):
    for name in ("op1", "op2", "op3", "op4", "op5", "op6", "op7"):
        rows = [tuple(r) for r in OPERATORS[name](plain, model, table).where("doc_id = 4").collect()]
        assert len(rows) == 2 and len(set(rows)) == 1, name


def test_chat_keeps_to_its_columns(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "a"), ("assistant", None), (None, "[END]"), ("user", "")])] + [(None, 0, "user", "no conversation"), (2, None, "user", "no turn"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    run = lambda t: Counter(map(tuple, chat.read_back(chat.format_paths(chat.branches(chat.from_turns(t)))).collect()))
    found = run(turns)
    assert {r[0]: r[1] for r in found} == {1: 4, None: 1, 2: 3}
    assert run(turns.select("*", *(F.lit(n).alias(n) for n in ("node", "parent", "score", "to", "steps", "total", "branch", "known", "depth", "m")))) == found


def test_chat_repeated_nodes_and_tied_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "z", 0.5), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", "tie", 0.5)]
    for order in (rows, rows[::-1]):
        messages = spark.createDataFrame(order, "conv_id long, node long, parent long, role string, text string, score double")
        assert [chat.parse_turns(r.formatted) for r in chat.format_paths(chat.branches(messages)).collect()] == [[("user", "q"), ("assistant", "a")]]


def test_score_against_a_plain_sum(spark, plain, model):
    """Each feature's weight, summed over a document one by one and averaged."""
    found = {r.doc_id: r.score for r in quality.score(plain, model).collect()}
    for r in plain.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        total, n = 0.0, 0
        for bucket, begins, ends in quality._features(data, np.array([0, len(data)])):
            for b in bucket[begins[0] : ends[0]].tolist():
                total, n = total + float(model.weights[b]), n + 1
        text = r.text or ""
        words = len(word_bounds(data, np.array([0, len(data)]))[0])
        again = sum(a == b for a, b in zip(text.split(), text.split()[1:]))
        assert n == words + again + sum(max(0, len(text) - k + 1) for k in quality.GRAMS)
        assert abs(found[r.doc_id] - 1 / (1 + np.exp(-(model.bias + total / max(1, n))))) < 1e-9


def test_neighbours_order_and_ties(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (120, 8)).astype(float)  # few different products: many ties
    v[:, 0] += (v == 0).all(axis=1)
    rows = [(i, x.tolist(), "further") for i, x in enumerate(v)]
    index = neighbours.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string").repartition(3))
    got = {}
    for r in neighbours.nearest(index, index.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 120, 20):
        score = v @ v[q]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == score[i] and i != q for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        wanted = sorted((i for i in range(120) if i != q), key=lambda i: (-score[i], i))[:20]
        hit += len(set(wanted) & {i for _, i, _ in found})
    assert hit >= 0.9 * 120


def test_mixture_against_a_simulation(spark):
    """Earliest deadline first, one slot after the other, in plain Python."""
    sizes = {"a": 37, "b": 12, None: 5, "d": 90}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, k in sizes.items() for _ in range(k))], "doc_id long, source string")
    shares = {r.source: r.share for r in mixing.shares(docs.groupBy("source").count().withColumnRenamed("count", "n")).collect()}
    period, block = sum(shares.values()), 3
    names = sorted(sizes, key=lambda s: (s is not None, s))  # as the schedule numbers them, for ties
    done, slot, want = dict.fromkeys(sizes, 0), 0, {}
    while any(done[s] * block < sizes[s] for s in sizes):
        ready = [(-(-(done[s] + 1) * period // shares[s]), n, s) for n, s in enumerate(names) if done[s] * block < sizes[s] and done[s] * period // shares[s] <= slot]
        if ready:
            s = min(ready)[2]
            done[s] += 1
            want[s, done[s]] = slot
        slot += 1
    found = mixing.mix(docs, block=block).collect()
    assert {(r.source, r.mix_block): r.mix_slot for r in found} == want
    assert all(r.mix_position // block == r.mix_slot for r in found) and len({r.mix_position for r in found}) == len(found)


def test_secrets_take_linear_time_and_leave_ordinary_names_alone(spark, table):
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (16, 20, 24, 32, 40) for _ in range(20)]
    names = ["org/apache/spark/sql/catalyst/v2", "/usr/share/locale/en_US/LC_MESSAGES/x1", "internationalization_configuration", "some-very-long-hyphenated-identifier-name", "Donaudampfschifffahrtsgesellschaft", "123e4567-e89b-12d3-a456-426614174000", "2024-01-15T10-30-00Z-backup", "customer_order_line_item_0001"]
    rows = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(keys + names)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.find(rows, table).collect() if any(s.kind == 3 for s in r.spans)}
    assert len(found & set(range(len(keys)))) >= 0.95 * len(keys) and not found - set(range(len(keys)))
    took = []
    for n in (50_000, 200_000):
        one = spark.createDataFrame([(1, " ".join("".join(rng.choice(letters) for _ in range(24)) for _ in range(n // 25)))], "doc_id long, text string").coalesce(1)
        began = time.time()
        spans = secrets.digests(secrets.find(one, table)).first().spans
        took.append(time.time() - began)
        assert spans.count(",") + 1 >= 0.99 * n // 25
    assert took[1] < 4 * took[0] + 5  # a square would be sixteen times


def test_spans_where_kinds_overlap(spark, table):
    texts = ["token=AKIA" + "ABCDEFGH12345678", "AKIA0123456789TOKEN=abcdefgh", "secret: " + "ab12" * 8 + " é password='x' token:" + "9" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.redact(rows, table).collect():
        base = next(x.base for x in secrets.find(rows.where(F.col("doc_id") == r.doc_id), table).collect())
        covered = {i for s in base for i in range(s.begin, s.end)}
        kept = "".join(c for i, c in enumerate(texts[r.doc_id]) if i not in covered)
        assert r.text.replace(secrets.REPLACEMENT, "") == kept


def test_pipeline_of_odd_rows(spark, tmp_path):
    """`run` from end to end, with null, empty and repeated rows, against each stage done plainly."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(10**9 + i, t, "en", "odd", 0) for i, t in enumerate((None, "", "password = hunter22 is " + PASSAGE, "password = hunter22 is " + PASSAGE))]
    odd.append(odd[2])
    kinds = {f.name: f.dataType for f in docs.schema}
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(kinds[c]).alias(c) for c in docs.columns))
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    good = {(r.doc_id, r.score) for r in quality.score(docs, quality.train(docs, labels)).collect() if r.predicted}
    kept = [r for r in docs.collect() if r.doc_id in {i for i, _ in good}]
    sets = {}
    for r in kept:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                    label[b], changed = label[a], True
    stay = Counter(r.doc_id for r in kept if label[r.doc_id] == r.doc_id)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == stay
    # Texts and places of the result, from the stages before it done on the rows that stay.
    left = docs.where(F.col("doc_id").isin(list(stay)))
    clean = {r.doc_id: r.text or "" for r in secrets.redact(left).collect()}
    encoder = bpe.vocabulary(PATH)
    assert all(r.input_ids == encoder.encode(clean[r.doc_id]) and r.n_tokens == len(r.input_ids) for r in found)
    assert len({r.mix_position for r in found}) == len(found)


def test_near_copies_of_tied_ids(spark):
    rows = [(2, PASSAGE), (2, PASSAGE), (3, PASSAGE + " "), (1, "something else with words of its own")]
    left = copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in left) == {2: 2, 1: 1}
