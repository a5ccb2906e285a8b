"""SimHash near-duplicates by BK-trees.

A fingerprint bit is the majority of that bit over the hashes of a document's word shingles. Two fingerprints within the
radius agree in at least one of radius + 1 blocks of bits, and in k of radius + k, so the distinct fingerprints are dealt by each
block's value, or by those of each choice of k blocks as there are more of them, which changes no link;
documents with equal fingerprints are one from here on. Each value's fingerprints form a BK-tree: a child's key is its
integer Hamming distance to the parent, and a search follows only edges whose key is within the radius of the query's own
distance. Trees go to tasks by shuffle, several to a shard, never to all tasks: their size grows with the corpus. A value
with more than `TREE` fingerprints becomes several trees, each searched by the others' fingerprints in a task of its own.
A task returns a spanning forest of its links, no pairs, and `components` joins the forests.

A null text is an empty one; texts without words have fingerprint zero; a very long text is one task's step of its own. A bit
that half the shingles have is 0. Repeated rows have equal results; an empty table gives an empty one; further columns are not
read, except by `drop_near_copies`, which returns them as they are, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, mix, stored, text_chunks, word_bounds
from .components import components

RADIUS, WIDTH, SEED = 4, 4, 42
#: Fingerprints of a tree, and of a shard of trees.
TREE, SHARD = 16_384, 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each; their begins and ends there; each document's first word."""
    starts, ends, first = word_bounds(data, offsets)
    length = ends - starts
    begins = np.concatenate([[0], np.cumsum(length + 1)])
    if not len(starts):
        return b"", starts, ends, first
    source = np.arange(begins[-1]) + np.repeat(starts - begins[:-1], length + 1)
    out = _LOWER[data[np.minimum(source, len(data) - 1)]]
    out[begins[1:] - 1] = 32
    return out.tobytes(), begins[:-1], begins[:-1] + length, first


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, and each document's begin and end among them."""
    text, begins, ends, first = normal_words(data, offsets)
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(shingles)])
    word = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], shingles)
    last = np.minimum(word + width, np.repeat(first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins[word].tolist(), ends[last].tolist())), np.uint64, len(word))
    return hashes, at[:-1], at[1:]


def majority(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begins), np.uint64)
    full = np.flatnonzero(ends > begins)
    step = 1 << 16  # documents are whole in a step; bits of a step's hashes are some MB
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(ends[full], begins[full[at]] + step, side="right")))
        own = full[at:to]
        low = begins[own[0]]
        bits = np.unpackbits(hashes[low : ends[own[-1]]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins[own] - low, axis=0, dtype=np.int32)
        wins = ones * 2 > (ends[own] - begins[own])[:, None]
        out[own] = np.packbits(wins, axis=1, bitorder="little").view("<u8").ravel()
        at = to
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f0, f1, … (longs whose bits they are, one for each 64 bits) of every whole text; no shuffle.

    The first 64 bits are of the shingles' hashes, further ones of those hashes mixed with the lane's number."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in text_chunks(batches):
            hashes, begins, ends = _shingles(data, offsets, width)
            found = [majority(mix(hashes + np.uint64(i)) if i else hashes, begins, ends) for i in range(lanes)]
            yield pa.record_batch([ids, *(pa.array(f.view(np.int64)) for f in found)], names=["doc_id", *names])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees, one for each group, over one array of fingerprints, a row of lanes each."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        self.root: dict[int, int] = {}
        parent, key = np.full(len(values), -1), np.zeros(len(values), np.int64)
        left, place = np.arange(len(values)), groups.astype(np.int64)
        top = True
        while len(left):
            # The first of each place becomes its node; the others go on to the child that their distance to it names.
            _, node_at, which = np.unique(place, return_index=True, return_inverse=True)
            nodes = left[node_at]
            if top:
                self.root = dict(zip(place[node_at].tolist(), nodes.tolist()))
                top = False
            rest = np.ones(len(left), bool)
            rest[node_at] = False
            node, left = nodes[which[rest]], left[rest]
            distance = _distance(values[left], values[node])
            parent[left], key[left] = node, distance  # final for those that become nodes below, as places only narrow
            place = node * 1024 + distance
        children = np.flatnonzero(parent >= 0)
        edge = parent[children] * 1024 + key[children]
        order = np.argsort(edge, kind="stable")
        self.edges, self.children = edge[order], children[order]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the queries: query numbers and members of their group's tree within the radius."""
        roots = np.array([self.root.get(g, -1) for g in groups.tolist()], np.int64)
        have = np.flatnonzero(roots >= 0)
        for at in range(0, len(have), 512):
            q = have[at : at + 512]
            node = roots[q]
            while len(q):
                distance = _distance(queries[q], self.values[node])
                near = distance <= radius
                yield q[near], node[near]
                low = np.searchsorted(self.edges, node * 1024 + np.maximum(distance - radius, 0), side="left")
                high = np.searchsorted(self.edges, node * 1024 + distance + radius, side="right")
                n = high - low
                child = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                q, node = np.repeat(q, n), self.children[child]


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of each pair; a label is the smallest index of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def _shard_links(radius: int, lanes: int):
    names = [f"f{i}" for i in range(lanes)]

    def run(rows: pa.Table) -> pa.Table:
        column = lambda n: rows.column(n).to_numpy()
        values = np.stack([column(n) for n in names], axis=1).view(np.uint64)
        cells = np.unique(np.stack([column(n) for n in ("value", "i", "j")], axis=1), axis=0, return_inverse=True)[1].ravel()
        tree, asks = np.flatnonzero(column("in_tree")), np.flatnonzero(column("asks"))
        forest = Forest(values[tree], cells[tree])
        label = np.arange(len(values))
        for q, node in forest.search(values[asks], cells[asks], radius):
            label = _hook(label, asks[q], tree[node])
        own = np.flatnonzero(label != np.arange(len(values)))
        nodes = column("node")
        return pa.table({"a": nodes[own], "b": nodes[label[own]]})

    return run


def exact_blocks(radius: int = RADIUS, n: int = 0, value: int = 1024) -> list[list[int]]:
    """Masks of 64 bits so that any two fingerprints within the radius agree on one of them at least.

    Of `radius` + k blocks such fingerprints agree on k at least, so every choice of k blocks is a mask. More blocks make more
    masks with more bits: k is the least that leaves some `value` of n fingerprints to a value of a mask. Links are the same."""
    for k in range(1, 64 // radius if radius else 2):
        bounds = [64 * i // (radius + k) for i in range(radius + k + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
        if n >> min(64 * k // (radius + k), 62) <= value:
            break
    return [[sum(chosen)] for chosen in itertools.combinations(blocks, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, masks: list[list[int]], radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """a, b: links whose components are those of all pairs within the radius that agree on a mask. `distinct`: node, f0, …"""
    lanes = len(masks[0])
    names = [f"f{i}" for i in range(lanes)]
    keys = F.array(*(F.xxhash64(F.lit(n), *(F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(names, mask))) for n, mask in enumerate(masks)))
    dealt = distinct.select("node", *names, F.explode(keys).alias("value"))
    sizes = dealt.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # Only values with too many fingerprints for a tree: at most a row for each `tree` rows dealt.
    large = cut(sizes.where(F.col("n") > tree).select("value", F.ceil(F.col("n") / tree).cast("long").alias("trees")))
    zero = F.lit(0).cast("long")
    whole = dealt.join(large, "value", "left_anti").select("node", *names, "value", zero.alias("i"), zero.alias("j"), F.lit(True).alias("in_tree"), F.lit(True).alias("asks"))
    cell = lambda i, j, in_tree, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(in_tree).alias("in_tree"), F.lit(asks).alias("asks"))
    numbers = F.sequence(zero, F.col("trees") - 1)
    cells = F.concat(F.array(cell(F.col("k"), F.col("k"), True, True)), F.transform(F.filter(numbers, lambda j: j > F.col("k")), lambda j: cell(F.col("k"), j, True, False)), F.transform(F.filter(numbers, lambda i: i < F.col("k")), lambda i: cell(i, F.col("k"), False, True)))
    split = dealt.join(large, "value").withColumn("k", F.pmod(F.xxhash64("node"), F.col("trees"))).select("node", *names, "value", F.explode(cells).alias("c")).select("node", *names, "value", "c.*")
    shards = max(1, -(-distinct.count() * len(masks) // SHARD))
    rows = whole.unionByName(split).withColumn("shard", F.pmod(F.xxhash64("value", "i", "j"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(_shard_links(radius, lanes), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, f0, component_id: the smallest doc_id that links reach. Rows without an id take part in no link."""
    rows = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(rows.groupBy("f0").agg(F.min("doc_id").alias("node")), "fingerprints")
    labels = components(links(distinct.where("node IS NOT NULL"), exact_blocks(radius, distinct.count()), radius))
    found = distinct.join(labels, "node", "left").select("f0", F.coalesce("label", "node").alias("component_id"))
    return rows.join(found, "f0").select("doc_id", "f0", "component_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without near copies: the trees' links, compared set with set, and exactly what they leave (`copies`)."""
    from . import copies

    return copies.drop_near_copies(docs)
