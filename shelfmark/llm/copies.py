"""Near copies: all pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

SimHash fingerprints of the sets are searched first, by the BK-trees of `simhash`: distinct fingerprints within the radius,
and sets of equal fingerprints, are candidates; those whose sets are alike are linked. A fingerprint only estimates a
similarity, so what the trees can't bring together is found exactly: two such sets, each put in one and the same order of all
shingles, share one of their first n - ceil(0.8 n) + 1 (prefix filter). The order is rare shingles first: those seen often
are counted beforehand and come last. The order decides about cost alone, so it may be rough. Prefix shingles that no other
set's prefix holds are dropped, and of the others only those are looked at that sets of different components share, as the
trees' links have joined them: each such set with one of those of the shingle, in a few rounds, and then, among those not
yet in one component, every pair, by sizes and bits, in blocks: a task compares some thousands of sets with some thousands
and tells the pairs that these don't part. So a large group of copies is no square of pairs, no pair that could join two
components is left out, and sets that share rare shingles and stay below 0.8 cost a comparison of bits, but hardly ever a
row. Of shingles that the very same sets hold, one stands for all.

Shingles are 64-bit hashes of lower-cased words. A text of one to four words is one shingle, a null, blank or empty one
holds a shingle of its own kind. Equal sets are one node, named by a hash of the set. Rows without an id take no part;
repeated rows stay or go together; an empty table gives an empty one. A very long text is one set, held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import forget, mix, repeated, rolling, sieve, sifted, span_hashes, stored, text_chunks
from .components import components

WIDTH = 5
#: Shingles that the list of frequent ones holds at most, the documents it takes to be on it, and the shingles counted at once.
FREQUENT, OFTEN, COUNTED = 100_000, 16, 1_000_000
#: Bits that tell sets apart before they are compared. Unlike sets differ in half of them at most, so some 9,000 shingles of
#: two sets together are too many to be told apart by them.
BITS = 2048
#: Nodes for each file of a table with small rows, and files that such a table may have anyway; texts of an Arrow batch.
SMALL_ROWS, SMALL_FILES, TEXTS = 10_000, 12, 500
#: Bytes of text that a step of these functions holds: it takes some 25 to 45 times as much, and workers give little of it back.
STEP_BYTES = 1 << 18
#: Rounds in which open nodes are compared with one node of each shingle, before blocks of so many are with each other.
HUBS, BLOCK = 2, 4096
_U = np.uint64


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ordered by document and hash, and the document of each."""
    text, begins, ends, first = simhash.normal_words(data, offsets)
    counts = np.diff(first)
    words = span_hashes(np.frombuffer(text, np.uint8), begins, ends) if text else np.zeros(0, _U)
    hashes, owners = [], []
    for width in range(1, WIDTH + 1):
        found = mix(rolling(words, width) + _U(width))
        own = np.flatnonzero(counts >= WIDTH if width == WIDTH else counts == width)
        n = counts[own] - width + 1
        owner = np.repeat(own, n)
        hashes.append(found[np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + first[owner]] if len(owner) else np.zeros(0, _U))
        owners.append(owner)
    blank = np.flatnonzero(counts == 0)
    value, doc = np.concatenate([*hashes, np.zeros(len(blank), _U)]), np.concatenate([*owners, blank])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], doc[fresh]


def _nodes(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw, bounds = value.tobytes(), [0, *(8 * ends).tolist()]
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(bounds, bounds[1:])), _U, len(ends)).view(np.int64)


def _lists(value: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(value.view(np.int64)))


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def counted() -> pa.RecordBatch:
        value, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(value[times > 2].view(np.int64)), pa.array(times[times > 2], pa.int64())], names=["shingle", "n"])

    for _, data, offsets in text_chunks(batches, STEP_BYTES):
        held.append(_sets(data, offsets)[0])
        n += len(held[-1])
        if n >= COUNTED:
            yield counted()
            held, n = [], 0
    if held:
        yield counted()


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and in how many documents they are: those seen more than twice among some
    million of a task are summed up. Of a fixed size, whatever the corpus."""
    counted = texts.mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    rows = stored(counted, "frequent", TEXTS).toArrow()
    value, times = rows.column("shingle").to_numpy().view(_U), rows.column("n").to_numpy()
    order = np.argsort(value)
    return value[order], times[order]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (doc_id, text, text_hash): node, number of shingles, fingerprint of the set, and for each of `BITS` remainders
    of its hashes whether it has an odd number of them."""
    for batch in batches:
        at = 0
        for ids, data, offsets in text_chunks([batch], STEP_BYTES):
            shingle, doc = _sets(data, offsets)
            n = np.bincount(doc, minlength=len(ids))
            ends = np.cumsum(n)
            marks = simhash.majority(shingle, ends - n, ends)
            odd = np.bincount(doc * BITS + (shingle % _U(BITS)).astype(np.int64), minlength=len(ids) * BITS).reshape(-1, BITS) & 1
            bits = pa.array([b.tobytes() for b in np.packbits(odd.astype(bool), axis=1)], pa.binary())
            yield pa.record_batch([ids, batch.column(2).slice(at, len(ids)), pa.array(_nodes(shingle, ends)), pa.array(n, pa.int32()), pa.array(marks.view(np.int64)), bits], names=["doc_id", "text_hash", "node", "n", "f0", "bits"])
            at += len(ids)


def _prefixes(value: np.ndarray, times: np.ndarray):
    """Chunks of values for `repeated`: the prefix of each text's set, owned by its node. Prefixes are the smallest of the
    rare shingles, so these are mixed again, or a fifth of the buckets would get them all."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for _, data, offsets in text_chunks(batches, STEP_BYTES):
            shingle, doc = _sets(data, offsets)
            n = np.bincount(doc, minlength=len(offsets) - 1)
            ends = np.cumsum(n)
            count = np.zeros(len(shingle), np.int64)
            if len(value):
                near = np.minimum(np.searchsorted(value, shingle), len(value) - 1)
                count = np.where(value[near] == shingle, times[near], 0)
            place = np.arange(len(shingle)) - np.repeat(ends - n, n)
            size = n - (4 * n + 4) // 5 + 1
            yield pa.array(_nodes(shingle, ends)), np.repeat(np.arange(len(n)), size), mix(shingle[np.lexsort((shingle, count, doc))][place < np.repeat(size, n)] + _U(1))

    return chunks


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (node, text): the set, as one binary of its hashes in order, its size, and parities of its hashes' remainders
    by a power of two of four times the size or more."""
    for ids, data, offsets in text_chunks(batches, STEP_BYTES):
        shingle, doc = _sets(data, offsets)
        bounds = np.append(0, np.cumsum(np.bincount(doc, minlength=len(ids)))).tolist()
        sets = [shingle[a:b] for a, b in zip(bounds, bounds[1:])]
        sizes = [max(BITS, 1 << (4 * len(s) - 1).bit_length()) for s in sets]
        wide = [np.packbits(np.bincount((s % _U(m)).astype(np.int64), minlength=m) & 1).tobytes() for s, m in zip(sets, sizes)]
        yield pa.record_batch([ids, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.binary())], names=["node", "shingles", "n", "wide"])


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities by a smaller power of two."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `_near_enough`, by bits as many as the sets ask for."""
    for batch in batches:
        near = []
        for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            size = min(len(x), len(y))
            near.append(9 * int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum(dtype=np.int64)) <= n + m)
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, x, y) those of Jaccard 0.8 or more: the shared ones are 4/9 of both sizes together."""
    for batch in batches:
        alike = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = np.sort(np.concatenate([x, y]))
            alike.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
        yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))


def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, n, m, x, y) those that may be alike: bits that differ are no more than what only one set holds, which
    is 1/9 of both sizes at most."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        yield batch.select([0, 1]).filter(pa.array(9 * apart <= batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()))


def _block_pairs(node: np.ndarray, n: np.ndarray, label: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two blocks' places, or of one's, that sizes and bits do not part, of different components."""
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        own = left[at : at + step]
        apart = np.zeros((len(own), len(right)), np.uint16)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[own, w][:, None] ^ bits[right, w][None, :])
        x, y = n[own][:, None], n[right][None, :]
        near = (9 * apart.astype(np.int64) <= x + y) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (label[own][:, None] != label[right][None, :])
        if same:
            near &= own[:, None] < right[None, :]
        i, j = np.nonzero(near)
        yield node[own[i]], node[right[j]]


def _meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b from rows (token, lo, hi, own, node, n, label, bits), which come by token, lo and hi: nodes of block lo with those of
    block hi that may be alike."""

    def met(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        node, n, label, own = (t.column(c).to_numpy() for c in ("node", "n", "label", "own"))
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        ends = list(_block_pairs(node, n.astype(np.int64), label, bits, np.flatnonzero(own == lo), np.flatnonzero(own == hi), lo == hi))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(e[k] for e in ends)]) for k in (0, 1))
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    now, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        begins = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(begins, np.append(begins[1:], len(keys))):
            key = tuple(keys[a])
            if key != now and held:
                yield met(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield met(held)


class Nodes:
    """What all steps know of the sets: nodes (node, n, f0, bits, doc_id, text_hash of a row), the texts (doc_id, text,
    text_hash), whether rows among them repeat, and how many files a table of small rows may have."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, again: bool):
        self.nodes, self.texts, self.again, self.small = nodes, texts, again, max(SMALL_FILES, nodes.count() // SMALL_ROWS)


def _near_within(tokens: DataFrame, known: Nodes) -> DataFrame:
    """Pairs a, b of nodes of different components that share a token and that sizes and bits do not part.

    The holders of a token are dealt into blocks of some `BLOCK`, and each two blocks meet in a task, which keeps the pairs that
    may be alike: what moves is a node for each block of its token, and no other pair becomes a row."""
    sizes = stored(tokens.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")), "holders", parts=known.small)
    rows = tokens.join(sizes, "token").join(known.nodes.select("node", "bits"), "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = rows.select("token", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "n", "label", "bits")
    return keyed.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_meet_blocks, "a long, b long").distinct()


def _sets_of(ends: DataFrame, known: Nodes) -> DataFrame:
    """node, shingles, n, wide of each node of `ends`. Texts that a sieve tells to be none of theirs don't move, nor do sets."""
    wanted = stored(known.nodes.join(ends, "node").select("node", "doc_id", "text_hash"), "ends", parts=known.small)
    key = F.col("doc_id"), F.col("text_hash")
    found = sifted(known.texts, sieve(wanted, *key), *key).join(wanted, ["doc_id", "text_hash"]).select("node", "text")
    found = found.dropDuplicates(["node"]) if known.again else found
    sets = stored(found.mapInArrow(_whole, "node long, shingles binary, n long, wide binary"), "sets", TEXTS)
    forget(wanted)
    return sets


def _alike(pairs: DataFrame, known: Nodes, near_enough: bool = False) -> DataFrame:
    """The pairs a, b of nodes whose sets are alike. Sets are made again from the texts, for nodes that are in pairs alone
    which their sizes and bits do not part (`near_enough`: as is known of these)."""
    one, two = (known.nodes.select(F.col("node").alias(c), F.col("n").alias(k), F.col("bits").alias(x)) for c, k, x in (("a", "n", "x"), ("b", "m", "y")))
    sized = pairs.join(one, "a").join(two, "b").where("5L * least(n, m) >= 4L * greatest(n, m)").select("a", "b", "n", "m", "x", "y")
    pairs = stored(pairs if near_enough else sized.mapInArrow(_near_enough, "a long, b long"), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(ends, known)
    of = lambda end, n, x, column: sets.select(F.col("node").alias(end), F.col("n").alias(n), F.col(column).alias(x))
    near = pairs.join(of("b", "m", "y", "wide"), "b").join(of("a", "n", "x", "wide"), "a").select("a", "b", "n", "m", "x", "y")
    near = stored(near.mapInArrow(_nearer, "a long, b long"), "near", 256)
    links = near.join(of("b", "m", "y", "shingles"), "b").join(of("a", "n", "x", "shingles"), "a").select("a", "b", "x", "y")
    links = stored(links.mapInArrow(_compare, "a long, b long"), "links", 64)
    forget(pairs, sets, near)
    return links


def _labelled(rows: DataFrame, links: DataFrame, known: Nodes) -> DataFrame:
    """`label`: the component of each row's node."""
    return rows.drop("label").join(components(links, known.small), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(rows: DataFrame, known: Nodes) -> DataFrame:
    """Rows of the tokens that nodes of different components hold; of tokens that the same nodes hold, of one."""
    held = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))), F.count(F.lit(1))
    tokens = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), *(h.alias(f"h{n}") for n, h in enumerate(held))).where("x <> y")
    tokens = tokens.groupBy("h0", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    return stored(rows.join(stored(tokens, "open", parts=known.small), "token", "left_semi"), "tokens", parts=known.small)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), copy_of: the smallest id of the component, of every row with an id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    rows = stored(texts.mapInArrow(_marks, "doc_id long, text_hash long, node long, n int, f0 long, bits binary"), "marks", TEXTS)
    nodes = rows.groupBy("node").agg(F.min("n").alias("n"), F.min("f0").alias("f0"), F.min("bits").alias("bits"), F.min(F.struct("doc_id", "text_hash")).alias("l"))
    nodes = stored(nodes.select("node", "n", "f0", "bits", "l.doc_id", "l.text_hash"), "nodes")
    known = Nodes(nodes, texts, not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty())
    # The trees: links of distinct fingerprints, and sets of one fingerprint with the first of them.
    marks = stored(nodes.groupBy("f0").agg(F.min("node").alias("node")), "fingerprints", parts=known.small)
    near = simhash.links(marks, simhash.exact_blocks(simhash.RADIUS, marks.count()))
    same = nodes.join(marks.withColumnRenamed("node", "a"), "f0").where("a <> node").select("a", F.col("node").alias("b"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    compared = near.unionByName(same).select(*pair("a", "b")).distinct()
    links = _alike(compared, known)
    # What the trees leave: prefix shingles that sets of different components share.
    n_shingles = rows.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    shared = stored(repeated(texts.select("doc_id", "text"), _prefixes(*frequent(texts)), n_shingles * 8, others=True), "prefixes", TEXTS)
    sizes = _labelled(nodes.select("node", "n"), links, known)
    tokens = _open(sizes.join(shared, sizes["node"] == shared["own"]).select("node", "n", "label", F.explode(F.array_distinct("values")).alias("token")), known)
    fits = "label <> other AND 5L * least(n, m) >= 4L * greatest(n, m)"
    asked = None
    for n in range(HUBS):
        order = F.xxhash64("node", F.pmod("token", F.lit(2)), F.lit(n))
        hubs = tokens.groupBy("token").agg(F.min(F.struct(order, "node", "n", "label")).alias("h"))
        hubs = hubs.select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("m"), F.col("h.label").alias("other"))
        pairs = tokens.join(stored(hubs, "hubs", parts=known.small), "token").where(fits).select(*pair("node", "hub")).distinct()
        pairs = stored(pairs if asked is None else pairs.join(asked, ["a", "b"], "left_anti"), "pairs", parts=known.small)
        if pairs.isEmpty():
            break
        asked = pairs if asked is None else asked.unionByName(pairs)
        links = links.unionByName(_alike(pairs, known))
        tokens = _open(_labelled(tokens, links, known), known)
    rest = _near_within(tokens, known)
    links = links.unionByName(_alike(rest if asked is None else rest.join(asked, ["a", "b"], "left_anti"), known, near_enough=True))
    found = stored(_labelled(rows.select("doc_id", "text_hash", "node"), links, known), "labels", parts=known.small)
    smallest = stored(found.groupBy("label").agg(F.min("doc_id").alias("copy_of")), "smallest", parts=known.small)
    return found.join(smallest, "label").select("doc_id", "text_hash", "copy_of")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, but for those with a near copy of a smaller id. Rows without an id stay."""
    gone = stored(near_copies(docs).where("doc_id <> copy_of").select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash")).distinct(), "gone")
    held = stored(sieve(gone, F.col("own"), F.col("own_hash")), "sieve")
    key = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    # Only documents that may be among them move.
    doubtful = sifted(docs, held, *key)
    return sifted(docs, held, *key, among=False).union(doubtful.join(gone, (key[0] == gone["own"]) & (key[1] == gone["own_hash"]), "left_anti"))
