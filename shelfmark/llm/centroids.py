"""Lloyd's clustering in exact integers, with a heap of bounds for each cluster.

Vectors lie in blocks. A block keeps, for each cluster, a heap of its members by the round in which their assignment may
first change: the gap between a lower bound on the distance to any other centroid and an upper bound on that to their own,
plus what the cluster's gaps had been drifted by when the gap was taken. When centroids move, each cluster's drift grows by
its own move and the largest move of another; only members whose gap is used up are popped and scanned against all centroids
again, exactly, and pushed with a new gap. Other vectors aren't looked at. Bounds are rounded outwards, and a gap of zero is
used up at once, so results are those of scanning every vector in every round.

A block carries the sums of its members by cluster, which popped vectors that move change; a round adds up the blocks' sums
(columns that are read alone), and the k centroids go through the driver. Every round is a table in the shared folder, the
one before is emptied. Blocks are as large as `BLOCK` for any table, so neither a frequent vector nor a large cluster meets in
one task.

Vectors that are null, of another dimension, or hold null or non-finite components take no part. Ids may be null or repeat:
each row is a vector; equal hashes of ids are ordered by components. Fewer vectors than k: as many clusters as vectors. No
vectors: no rows. Only the id and vector columns are read. Components are to be below 2 ** 27 once scaled, or squared
distances leave 64 bits; beyond that the operator fails and says so.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Vectors of a block.
BLOCK = 4096
LIMIT = 1 << 27
_STATE = "ids array<long>, vectors binary, near binary, heap_keys binary, heap_members binary, heap_sizes array<int>, sums array<long>, popped int"


def scaled(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as integers floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    whole = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(key, "v").limit(k).collect()
    return np.array([r.v for r in found], dtype=np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and the gap to the second, rounded down."""
    d = squared(x, centroids)
    near = d.argmin(1)
    at = np.arange(len(x))
    own = np.sqrt(d[at, near].astype(np.float64))
    if d.shape[1] == 1:
        return near, np.full(len(x), np.inf)
    d[at, near] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(1).astype(np.float64))
    return near, (other - own) - 1e-9 * (other + own)


class Block:
    """Some vectors with their clusters, heaps and sums."""

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.near = np.full(len(x), -1, np.int32)
        self.heaps: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int32))] * k
        self.sums = np.zeros((k, x.shape[1] + 1), np.int64)
        self.popped = 0

    def assign(self, at: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Scans the vectors at some places, moves them, and pushes them to their cluster's heap."""
        near, gap = scan(self.x[at], centroids)
        moved = near != self.near[at]
        rows = np.concatenate([self.x[at[moved]], np.ones((int(moved.sum()), 1), np.int64)], axis=1)
        had = self.near[at[moved]]
        np.subtract.at(self.sums, had[had >= 0], rows[had >= 0])
        np.add.at(self.sums, near[moved], rows)
        self.near[at] = near
        keys = gap + drift[near]
        for c in np.unique(near):
            new = near == c
            heap = list(zip(self.heaps[c][0].tolist(), self.heaps[c][1].tolist()))
            if heap:
                for entry in zip(keys[new].tolist(), at[new].tolist()):
                    heapq.heappush(heap, entry)
            else:
                heapq.heapify(heap := list(zip(keys[new].tolist(), at[new].tolist())))
            self._keep(c, heap)

    def _keep(self, c: int, heap: list) -> None:
        self.heaps[c] = (np.array([e[0] for e in heap], np.float64), np.array([e[1] for e in heap], np.int32))

    def step(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Pops what a drift has used up, and scans it."""
        popped: list[int] = []
        for c, (keys, members) in enumerate(self.heaps):
            if len(keys) and keys[0] <= drift[c]:
                heap = list(zip(keys.tolist(), members.tolist()))
                while heap and heap[0][0] <= drift[c]:
                    popped.append(heapq.heappop(heap)[1])
                self._keep(c, heap)
        self.popped = len(popped)
        if popped:
            self.assign(np.array(popped, np.int32), centroids, drift)

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int, dim: int) -> Block:
        ids, vectors, near, keys, members, sizes, sums, _ = (batch.column(j)[row] for j in range(8))
        sizes = sizes.values.to_numpy().astype(np.int64)
        found = cls(ids.values, np.frombuffer(vectors.as_py(), np.int32).reshape(-1, dim).astype(np.int64), len(sizes))
        found.near = np.frombuffer(near.as_py(), np.int32).copy()
        ends = np.cumsum(sizes)[:-1]
        found.heaps = list(zip(np.split(np.frombuffer(keys.as_py(), np.float64), ends), np.split(np.frombuffer(members.as_py(), np.int32), ends)))
        found.sums = sums.values.to_numpy().reshape(len(sizes), dim + 1).copy()
        return found

    def write(self) -> pa.RecordBatch:
        join = lambda j: np.concatenate([h[j] for h in self.heaps]).tobytes()
        sizes = [len(h[0]) for h in self.heaps]
        columns = [pa.array([self.ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in (self.x.astype(np.int32).tobytes(), self.near.tobytes(), join(0), join(1))), pa.array([sizes], pa.list_(pa.int32())), pa.array([self.sums.ravel()], pa.list_(pa.int64())), pa.array([self.popped], pa.int32())]
        return pa.record_batch(columns, names=[c.split()[0] for c in _STATE.split(", ")])


def _pack(centroids: np.ndarray, size: int):
    """Blocks from rows of (vec_id, v), assigned for the first time."""
    k, dim = centroids.shape

    def block(ids: list, parts: list) -> pa.RecordBatch:
        x = np.concatenate(parts)
        if np.abs(x).max() >= LIMIT:
            raise ValueError(f"components of {LIMIT} and more leave 64 bits when squared distances are summed")
        made = Block(pa.concat_arrays(ids), x, k)
        made.assign(np.arange(len(x), dtype=np.int32), centroids, np.zeros(k))
        made.popped = len(x)
        return made.write()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                at, n = at + part.num_rows, n + part.num_rows
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
                if n == size:
                    yield block(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield block(ids, parts)

    return run


def _step(centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.read(batch, row, centroids.shape[1])
                block.step(centroids, drift)
                yield block.write()

    return run


def _members(centroids: np.ndarray):
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.read(batch, row, centroids.shape[1])
                away = block.x - centroids[block.near]
                yield pa.record_batch([block.ids, pa.array(block.near), pa.array((away * away).sum(1))], names=["vec_id", "cluster", "distance"])

    return run


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means; a cluster without members keeps its centroid."""
    k, dim = centroids.shape
    found = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect()  # k rows of dim + 1 numbers
    sums = np.zeros(k * (dim + 1), np.int64)
    for pos, total in found:
        sums[pos] = total
    sums = sums.reshape(k, dim + 1)
    counts = sums[:, -1:]
    return np.where(counts > 0, sums[:, :-1] // np.maximum(counts, 1), centroids)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Rows of vec_id, cluster, distance (squared); the centroids; and how many vectors each assignment scanned. `rounds` times
    vectors are assigned and centroids replaced; then vectors are assigned once more."""
    rows = scaled(vectors, id_col, vec_col, dim, scale)
    centroids = seeds(rows, k, salt)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids.reshape(0, dim), []
    keep = lambda df: stored(df, "blocks", batch_rows=8)
    blocks = stored(rows.mapInArrow(_pack(centroids, block), _STATE), "blocks")
    drift, scanned = np.zeros(len(centroids)), [blocks.agg(F.sum("popped")).first()[0]]
    for _ in range(rounds):
        after = _means(blocks, centroids)
        moves = np.sqrt(((after - centroids) ** 2).sum(1).astype(np.float64)) * (1 + 1e-9)
        if not moves.any():
            break  # no later round changes anything
        others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(len(moves))])
        centroids, drift = after, (drift + moves + others) * (1 + 1e-12)
        before, blocks = blocks, keep(blocks.mapInArrow(_step(centroids, drift), _STATE))
        forget(before)
        scanned.append(blocks.agg(F.sum("popped")).first()[0])
    members = stored(blocks.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"), "members")
    forget(blocks)
    return members, centroids, scanned


def digests(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256. What is joined has a row for each cluster."""
    sums = dict(members.groupBy("cluster").agg(F.sum("distance")).collect())
    total = sum(sums.values())
    shas = [(c, sums[c], total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist()) if c in sums]
    table = members.sparkSession.createDataFrame(shas, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
