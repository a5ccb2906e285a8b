"""Quality classifier: supervised subword embeddings.

Hashed words and character n-grams have learned vectors, and so has the event that a word repeats the one before, which the
labels turn on and no bag of words shows; a document is the average of the vectors of all that it holds, and a softmax layer
on it gives the two classes. Vectors and layer are trained by stochastic gradient descent in numpy, on the driver, over at
most `sample` labelled documents (those with the smallest hash of their id), whose bags of features executors prepare: at
worst 2^16 features of 8 bytes for each of them, one GB. For scoring, the layer is folded into the vectors: each feature then
adds one number, so a whole text of any length takes one pass.

A null text is an empty one and scores by the layer's bias alone. Without labelled documents of both classes every score is
0.5. A null label or id is not learned from; of several labels of an id the smallest counts. Repeated rows are scored each;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, id_text, rolling, span_hashes, text_chunks, word_bounds

#: Bits of the hashed feature table; words and n-grams have a half each.
BITS = 16
GRAMS = (3, 5)
DIM = 8
EPOCHS = 6
BATCH = 32
RATE = 0.5
#: Most labelled documents to learn from.
SAMPLE = 2000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """What one occurrence of each feature adds to the log-odds of label 1, and the bias."""

    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket of each occurrence, and where each document's begin and end."""
    half = 1 << (BITS - 1)
    starts, ends, first = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    yield np.maximum((words >> np.uint64(65 - BITS)).astype(np.int32), 1), first[:-1], first[1:]
    # A word that repeats the one before it is one more occurrence of feature 0, whatever the word.
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    runs = np.concatenate([[0], np.cumsum(again)])[first]
    yield np.zeros(int(again.sum()), np.int32), runs[:-1], runs[1:]
    characters = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    # A character begins at each byte that does not continue one.
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = (characters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        grams = rolling(codes, n) * np.uint64(0xD6E8FEB86659FD93)
        yield half + (grams >> np.uint64(65 - BITS)).astype(np.int32), np.minimum(begins[:-1], len(grams)), np.clip(begins[1:] - n + 1, np.minimum(begins[:-1], len(grams)), len(grams))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each span, for itself, so that equal texts get equal sums."""
    padded = np.append(values, 0.0)
    at = np.stack([starts, ends], axis=1).ravel()
    return np.where(ends > starts, np.add.reduceat(padded, at)[::2], 0.0) if len(at) else np.zeros(0)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its buckets, of 16 bits, and how often each is there, compressed, as the driver gets them."""
    for ids, data, offsets in text_chunks(batches):
        kinds, rows = list(_features(data, offsets)), []
        for i in range(len(ids)):
            bucket, count = np.unique(np.concatenate([b[s[i] : e[i]] for b, s, e in kinds]), return_counts=True)
            rows.append((bucket.astype("<u2").tobytes(), zlib.compress(count.astype("<i4").tobytes(), 1)))
        yield pa.record_batch([ids, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learns from labelled documents that are not held out; `labels` has doc_id and the target, 0 or 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bags = id_text(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, buckets binary, counts binary")
    rows = bags.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y"), F.min_by("buckets", F.length("buckets")), F.min_by("counts", F.length("buckets"))).collect()  # at most `sample` rows
    rows.sort(key=lambda r: r[0])
    return fit([(np.frombuffer(r[2], "<u2"), np.frombuffer(zlib.decompress(r[3]), "<i4")) for r in rows], np.array([r[1] for r in rows], dtype=np.int64), seed)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, c in bags]
    steps, done = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = [i for i in order[at : at + BATCH] if len(bags[i][0])]
            if not own:
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            index, share = np.concatenate([bags[i][0] for i in own]), np.concatenate([shares[i] for i in own])
            starts = np.cumsum([0, *(len(bags[i][0]) for i in own[:-1])])
            mean = np.add.reduceat(vectors[index] * share[:, None], starts, axis=0)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            back = np.repeat(p @ layer.T, np.diff([*starts, len(index)]), axis=0) * share[:, None]
            layer -= rate * mean.T @ p
            bias -= rate * p.mean(axis=0)
            touched, slot = np.unique(index, return_inverse=True)
            step = np.bincount((slot[:, None] * DIM + np.arange(DIM)).ravel(), back.ravel(), len(touched) * DIM)
            vectors[touched] -= (rate * 20 * step).reshape(-1, DIM).astype(np.float32)
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def _scorer(model: Model, step_bytes: int = CHUNK_BYTES):
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in text_chunks(batches, step_bytes):
            total, n = np.zeros(len(ids)), np.zeros(len(ids))
            for bucket, starts, ends in _features(data, offsets):
                total += _sums(weights[bucket].astype(np.float64), starts, ends)
                n += ends - starts
            z = bias + total / np.maximum(n, 1)
            yield pa.record_batch([ids, pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no shuffle. The model is 256 KB, whatever the corpus."""
    scored = id_text(docs).mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns as they are, that the model accepts; no shuffle. In small steps, as workers hold whole rows too
    and keep for later stages what a step took."""
    names, run = docs.columns, _scorer(model, CHUNK_BYTES // 4)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text")).fill_null("")
            rows = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), text], names=["doc_id", "text"])
            scores = np.concatenate([b.column(1).to_numpy() for b in run([rows])]) if batch.num_rows else np.zeros(0)
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(accepted, docs.schema)
