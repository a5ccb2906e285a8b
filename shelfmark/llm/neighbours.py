"""Nearest neighbours by inner product, over randomly rotated one-bit codes.

The index keeps for each vector the signs of its components after a random rotation, packed in 64-bit words, its length, and
how well the signs point along it. A query's rotated components are rounded to `STEPS` bits, so an estimate of the inner
product is a few bit counts of words, two scalars of the query and two corrections of the code, and the corrections give an
error bound for it. In each pair of blocks the best estimates are computed in full first; their 20th value is the mark, and
every vector whose estimate plus bound reaches the mark is computed in full too. The bound holds with high probability, not
surely, so the result is approximate; tests measure recall against brute force.

Blocks: candidates are dealt into buckets by a hash of their row, queries into groups, and each pair of a bucket and a group
is one task's work, of bounded size. Every row is indexed. Vectors that are null, zero, or hold null or non-finite components
take no part; vectors of another length than the query's are no candidates. Scores that tie go by vec_id. Rows that
repeat a vec_id are rows of their own: each is a candidate for all others, and each query among them gets its own k. An empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Nearest to return; candidates and queries in a block; estimates computed in full before the mark is set.
K, BUCKET, GROUP, FIRST = 20, 8192, 2048, 64
#: Width of the error bound in standard deviations of the code's error; bits of a query's rounded components.
WIDTH, STEPS = 2.5, 5
SEED = 11


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _estimates(turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of each query's rotated components by each code's signs, from counts of common bits."""
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**STEPS - 1), 1e-300)
    rounded = np.rint((turned - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float32)
    common = np.zeros((len(turned), len(codes)), np.int32)
    for bit in range(STEPS):
        planes = _words((rounded >> bit) & 1 > 0)
        for word in range(codes.shape[1]):
            common += np.bitwise_count(planes[:, word, None] & codes[None, :, word]).astype(np.int32) << bit
    return 2 * (low.astype(np.float32) * ones + step.astype(np.float32) * common) - turned.sum(axis=1, keepdims=True).astype(np.float32)


def index(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (its number in the index), vec_id, dim, vec (float64 bytes), code (packed signs), size (length), along (the
    correction); written once, without a shuffle."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine).select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = part.column(1).flatten().to_numpy().reshape(-1, dim)
                size = np.sqrt((vectors * vectors).sum(axis=1))
                turned = (vectors / size[:, None]) @ rotation(int(dim))
                along = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                codes = _words(turned >= 0)
                yield pa.record_batch([part.column(3), part.column(0), part.column(2), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(size), pa.array(along)], names=["row", "vec_id", "dim", "vec", "code", "size", "along"])

    return stored(rows.mapInArrow(run, "row long, vec_id long, dim int, vec binary, code binary, size double, along double"), "index")


def _search(k: int):
    empty = pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return empty
        dim = int(queries["dim"].iloc[0])
        matrix = lambda frame: np.frombuffer(b"".join(frame["vec"]), np.float64).reshape(-1, dim)
        q, c, q_rows, q_ids = matrix(queries), matrix(candidates), queries["row"].to_numpy(), queries["vec_id"].to_numpy()
        c_rows, c_ids = candidates["row"].to_numpy(), candidates["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(candidates["code"]), np.uint64).reshape(len(c), -1)
        size, along = candidates["size"].to_numpy(), np.maximum(candidates["along"].to_numpy(), 1e-9)
        spread = (size * np.sqrt(np.maximum(1 - along * along, 0)) / along * WIDTH / np.sqrt(max(dim - 1, 1))).astype(np.float32)
        gain = (size / along / np.sqrt(dim)).astype(np.float32)
        outs = []
        for at in range(0, len(q), 128):
            part, rows, ids = q[at : at + 128], q_rows[at : at + 128], q_ids[at : at + 128]
            guess = _estimates(part @ rotation(dim), codes) * gain
            guess[rows[:, None] == c_rows[None, :]] = -np.inf
            first = min(len(c), max(FIRST, 2 * k))
            top = np.argpartition(-guess, first - 1, axis=1)[:, :first]
            exact = np.einsum("qd,qfd->qf", part, c[top])
            exact[np.isneginf(np.take_along_axis(guess, top, axis=1))] = -np.inf
            mark = -np.partition(-exact, k - 1, axis=1)[:, k - 1] if first >= k else np.full(len(part), -np.inf)
            length = np.sqrt((part * part).sum(axis=1)).astype(np.float32)
            qi, ci = np.nonzero((guess + length[:, None] * spread >= (mark - 1e-5 * np.abs(mark))[:, None]) & ~np.isneginf(guess))
            score = np.concatenate([np.zeros(0), *((part[qi[i : i + 65536]] * c[ci[i : i + 65536]]).sum(axis=1) for i in range(0, len(qi), 65536))])
            order = np.lexsort((c_ids[ci], -score, qi))
            place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order], side="left")
            order = order[place < k]
            outs.append(pd.DataFrame({"query_row": rows[qi[order]], "query_id": ids[qi[order]], "vec_id": c_ids[ci[order]], "score": score[order]}))
        return pd.concat(outs)

    return run


def nearest(indexed: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of `queries`, rows of the index, among all others."""
    buckets, groups = max(1, -(-indexed.count() // BUCKET)), max(1, -(-queries.count() // GROUP))
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    left, right = dealt(queries, "g", groups, "b", buckets), dealt(indexed, "b", buckets, "g", groups)
    found = left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b")).applyInPandas(_search(k), "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
