"""Collocations: phrases of two to four words that are frequent in a language, scored by how tightly their words hold together.

First pass, a length of phrase at a time: tasks count the phrases of their texts and deal the counts to hash partitions, where
Misra-Gries summaries merge them. A partition's summary holds more counters than its mass divided by the threshold, so every
phrase at or over the threshold is left in it, whatever the texts; what a counter may have lost is known, and counters that
cannot reach the threshold go. A partition learns its mass before any counts come, as rows of masses sort first. The phrases
left set bits of a filter of fixed size, each partition its own slice; of longer phrases only those are counted whose both
shorter ones pass. The filter decides about cost alone.

Second pass: phrases of all lengths that pass the filters are counted by their words. Those at or over the threshold are
exact, and with them their parts, which are as frequent at least. The rest is joins and aggregates of that table.

In the first pass a phrase is a 64-bit hash of language and words; phrases that share one only add up there. In the second a
task adds up what shares a hash within some 6 MB of text, and then counts by the words themselves.

A null language is `und`, a null text an empty one; repeated rows count as often as they come, ids aren't read. An empty table
gives an empty one. Texts and words of any length are whole; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, rolling, span_hashes, stored, text_chunks, word_bounds

THRESHOLD, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Counters of a summary over the least that it needs; bits of a filter; bytes of text for a hash partition, and most partitions.
SLACK, FILTER_BITS, PART_BYTES, PARTS = 4, 1 << 26, 16 << 20, 1 << 16
#: Phrases that a task sorts at once in the first pass; bytes of text whose phrases it adds up in the second, and phrases of a batch.
DEALT, HELD, TOLD = 1 << 20, 6 << 20, 1 << 16
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that end a piece, and those that end a word.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAPS = ENDS.copy()
GAPS[[0x20, 0x09]] = True


class Words:
    """The words of a chunk: bytes in lower case, bounds, pieces, languages."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, firsts = word_bounds(self.data, offsets, GAPS)
        self.doc = np.repeat(np.arange(len(langs)), np.diff(firsts))
        self.piece = np.cumsum(ENDS[self.data])[self.starts] + self.doc if len(self.starts) else self.doc
        self.langs = langs
        code = langs.dictionary_encode()
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), seed=1) for x in code.dictionary.to_pylist()], dtype=np.uint64)
        self.seed = seeds[code.indices.to_numpy()][self.doc]
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def phrases(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on."""
        n = max(0, len(self.hashes) - k + 1)
        return mix(rolling(self.hashes, k)[:n] ^ (self.seed[:n] + _U(k)))

    def within(self, k: int) -> np.ndarray:
        """Whether they lie in one piece."""
        n = max(0, len(self.hashes) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def frequent(self, k: int, filters: list[Filter]) -> np.ndarray:
        """Whether the two shorter phrases of each phrase of k words may be frequent, and it lies in one piece."""
        if k == 1:
            return np.ones(len(self.hashes), dtype=bool)
        shorter = filters[k - 2].has(self.phrases(k - 1))
        return self.within(k) & shorter[:-1] & shorter[1:]


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


class Filter:
    """A Bloom filter in slices, one for each hash partition, so that each partition fills its own."""

    def __init__(self, parts: int, bits: int, data: np.ndarray):
        self.parts, self.slice, self.data = parts, slice_bits(parts, bits), data

    def has(self, values: np.ndarray) -> np.ndarray:
        base = part_of(values, self.parts) * self.slice
        out = np.ones(len(values), dtype=bool)
        for n in range(3):
            at = base + _places(values, n, self.slice)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def slice_bits(parts: int, bits: int) -> int:
    return max(64, bits // parts // 8 * 8)


def _places(values: np.ndarray, n: int, size: int) -> np.ndarray:
    return (mix(values ^ _U(0x9E37 + n)) % _U(size)).astype(np.int64)


def _slice(values: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, dtype=np.uint8)
    for n in range(3):
        bits[_places(values, n, size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Summary:
    """Misra-Gries: at most `capacity` counters; what goes lowers all by the largest that has no room, so a count is too low by
    `lost` at most, and that times capacity + 1 is no more than the mass that came."""

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.waiting, self.n = capacity, 0, [], 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((values, counts))
        self.n += len(values)
        if self.n >= max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        values = np.concatenate([self.values, *(v for v, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n = [], 0
        order = np.argsort(values, kind="stable")
        values = values[order]
        begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
        self.values, self.counts = values[begins], np.add.reduceat(counts[order], begins) if len(begins) else counts
        if len(self.values) > self.capacity:
            down = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > down
            self.values, self.counts, self.lost = self.values[left], self.counts[left] - down, self.lost + down

    def survivors(self, threshold: int) -> np.ndarray:
        """All that may have come `threshold` times."""
        self.merge()
        return self.values[self.counts + self.lost >= threshold]


def _deal(k: int, parts: int, shared: list):
    """Rows of two kinds: a task's mass in a partition (counts is null), and values with their counts."""
    names = ["part", "later", "mass", "values", "counts"]

    def dealt(held: list, masses: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        part = part_of(values, parts)  # ascending, as the values are
        which, begins = np.unique(part, return_index=True)
        ends = np.append(begins[1:], len(values))
        mass = np.add.reduceat(counts, begins)
        masses[which] += mass
        counts = counts.astype(np.int32)
        blobs = [[a[b:e].tobytes() for b, e in zip(begins, ends)] for a in (values, counts)]
        yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array(np.ones(len(which), np.int32)), pa.array(mass.astype(np.int64)), *(pa.array(b, pa.binary()) for b in blobs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [s.value for s in shared]
        held, n, masses = [], 0, np.zeros(parts, np.int64)
        for langs, data, offsets in text_chunks(batches):
            words = Words(langs, data, offsets)
            if len(words.hashes) < k:
                continue
            held.append(words.phrases(k)[words.frequent(k, filters)])
            n += len(held[-1])
            if n >= DEALT:
                yield from dealt(held, masses)
                held, n = [], 0
        if n:
            yield from dealt(held, masses)
        which = np.flatnonzero(masses)
        yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array(np.zeros(len(which), np.int32)), pa.array(masses[which]), pa.nulls(len(which), pa.binary()), pa.nulls(len(which), pa.binary())], names=names)

    return run


def _summarise(threshold: int, slack: int, size: int):
    """part, bits, found, lost: of each partition its slice of the filter, the phrases left and what a counter lost at most;
    rows come by partition, masses first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None

        def made() -> pa.RecordBatch:
            left = summary.survivors(threshold) if summary else np.zeros(0, np.uint64)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([_slice(left, size)], pa.binary()), pa.array([len(left)], pa.int64()), pa.array([summary.lost if summary else 0], pa.int64())], names=["part", "bits", "found", "lost"])

        for batch in batches:
            for part, later, m, values, counts in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), batch.column(4)):
                if part != now:
                    if now is not None:
                        yield made()
                    now, mass, summary = part, 0, None
                if not later:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(slack * (mass // threshold + 1))
                summary.add(np.frombuffer(values.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64))
        if now is not None:
            yield made()

    return run


def _count(shared: list, longest: int):
    """lang, k, phrase, a: how often a task saw each phrase that passes; k = 0: how many words the language has."""

    def counted(held: list, filters: list) -> Iterator[pa.RecordBatch]:
        langs = pa.concat_arrays([w.langs for w in held]).dictionary_encode()
        shift = np.cumsum([0, *(len(w.langs) for w in held[:-1])])
        lang = langs.indices.to_numpy()
        doc = np.concatenate([w.doc + s for w, s in zip(held, shift)])
        total = np.bincount(lang[doc], minlength=len(langs.dictionary)) if len(doc) else np.zeros(len(langs.dictionary), np.int64)
        yield pa.record_batch([langs.dictionary, pa.nulls(len(total), pa.int32()).fill_null(0), pa.array([""] * len(total)), pa.array(total.astype(np.int64))], names=["lang", "k", "phrase", "a"])
        sizes = np.cumsum([0, *(len(w.data) for w in held)])
        text = np.concatenate([np.where(w.data == 9, 32, w.data).astype(np.uint8) for w in held])
        starts, ends = (np.concatenate([getattr(w, x) + s for w, s in zip(held, sizes)]) for x in ("starts", "ends"))
        first_word = np.cumsum([0, *(len(w.hashes) for w in held)])
        for k in range(1, longest + 1):
            values, at = [], []
            for w, base in zip(held, first_word):
                own = w.phrases(k)
                passed = np.flatnonzero(filters[k - 1].has(own) & w.within(k))
                values.append(own[passed])
                at.append(passed + base)
            values, at = np.concatenate(values), np.concatenate(at)
            _, first, times = np.unique(values, return_index=True, return_counts=True)
            for n in range(0, len(first), TOLD):
                own = at[first[n : n + TOLD]]
                bounds, flat = _joined(text, starts, ends, own, k)
                told = pa.Array.from_buffers(pa.string(), len(own), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.record_batch([langs.dictionary.take(pa.array(lang[doc[own]])), pa.array(np.full(len(own), k, np.int32)), told, pa.array(times[n : n + TOLD].astype(np.int64))], names=["lang", "k", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [s.value for s in shared]
        held, n = [], 0
        for langs, data, offsets in text_chunks(batches):
            held.append(Words(langs, data, offsets))
            n += len(data)
            if n >= HELD:
                yield from counted(held, filters)
                held, n = [], 0
        if held:
            yield from counted(held, filters)

    return run


def _joined(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k words from each of some words on, joined by one space: their bounds in one buffer of bytes, and that."""
    words = (at[:, None] + np.arange(k)).ravel()
    lengths = ends[words] - starts[words] + 1  # and a space
    lengths[k - 1 :: k] -= 1
    to = np.cumsum(lengths)
    source = np.arange(to[-1] if len(to) else 0) + np.repeat(starts[words] - (to - lengths), lengths)
    flat = text[np.minimum(source, max(0, len(text) - 1))]
    inner = np.ones(len(words), dtype=bool)
    inner[k - 1 :: k] = False
    flat[to[inner] - 1] = 32
    return np.append(0, to[k - 1 :: k]), flat


def filters(rows: DataFrame, n_bytes: int, threshold: int = THRESHOLD, longest: int = LONGEST, slack: int = SLACK, bits: int = FILTER_BITS) -> tuple[list, list[dict]]:
    """A shared filter for each length, and what its summaries held. `rows`: lang, text."""
    spark = rows.sparkSession
    parts = min(PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES)))
    size, shared, told = slice_bits(parts, bits), [], []
    for k in range(1, longest + 1):
        dealt = rows.mapInArrow(_deal(k, parts, shared), "part int, later int, mass long, `values` binary, counts binary")
        met = dealt.repartition(parts, "part").sortWithinPartitions("part", "later")
        slices = stored(met.mapInArrow(_summarise(threshold, slack, size), "part int, bits binary, found long, lost long"), "summaries", batch_rows=64)
        data = np.zeros(parts * size // 8, np.uint8)
        found = lost = 0
        for r in slices.collect():  # as many bits together as a filter has
            data[r.part * size // 8 : (r.part + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
            found, lost = found + r.found, max(lost, r.lost)
        told.append({"k": k, "found": found, "lost": lost})
        shared.append(spark.sparkContext.broadcast(Filter(parts, bits, data)))
    return shared, told


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, slack: int = SLACK, bits: int = FILTER_BITS) -> DataFrame:
    """lang, k, phrase, a: all phrases of up to `longest` words that come `threshold` times or more; k = 0: words of a language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared, _ = filters(rows, n_bytes, threshold, longest, slack, bits)
    seen = rows.mapInArrow(_count(shared, longest), "lang string, k int, phrase string, a long")
    return stored(seen.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a")).where(f"a >= {threshold} OR k = 0"), "phrases", batch_rows=20_000)


def collocations(counted: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top`, from the table of `counts`."""
    words = F.split("phrase", " ")
    join = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    found = counted.where("k >= 2")
    cuts = found.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn("first_part", join(F.lit(1), F.col("cut"))).withColumn("rest", join(F.col("cut") + 1, F.col("k") - F.col("cut")))
    own = counted.where("k >= 1")
    left = own.select("lang", F.col("phrase").alias("first_part"), F.col("a").alias("l"))
    right = own.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "first_part"]).join(right, ["lang", "rest"]).withColumn("score", F.expr("CAST((CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: join(i, n))))
    around = counted.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {share}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    n = counted.where("k = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
