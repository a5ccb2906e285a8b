"""Helpers shared by the corpus operators: table access, bounded chunks of text, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer document is one step of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The two columns that text operators read. A null text is an empty one; other columns but those to keep are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder, of `parts` files at most; for small tables."""
    spark, df = df.sparkSession, df.coalesce(parts) if parts else df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()


#: While a table is stored: shuffle files go when the execution ends, and Arrow batches, which JVM and worker both hold, are
#: of fewer rows, as rows are texts.
_WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "{}"}


def stored(df: DataFrame, purpose: str, batch_rows: int = 2000, parts: int | None = None) -> DataFrame:
    """Written as Parquet to a new shared folder and read again: made once, of known size, with no shuffle files left behind.
    `batch_rows`: rows of an Arrow batch on the way, few where rows are large; `parts`: files at most, few where tables are
    small, as an executor starts processes for each file that it writes."""
    spark, where = df.sparkSession, shared_dir(df.sparkSession, purpose)
    df = df.coalesce(parts) if parts else df
    had = {k: spark.conf.get(k, None) for k in _WHILE_STORED}
    for k, v in _WHILE_STORED.items():
        spark.conf.set(k, v.format(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(where)
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(where)
    found._stored_at = where
    return found


def forget(*tables: DataFrame) -> None:
    """Empties the folders of stored tables that nothing reads any more."""
    for df in tables:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df._stored_at)


#: Words of 64 bits that a sieve has at most, for any number of keys.
SIEVE = 1 << 18


def sieve(keys: DataFrame, *columns: Column) -> DataFrame:
    """word, bits: a bit for each remainder of the keys' hash. It has 4 MB at most; once full it lets all through."""
    at = F.xxhash64(*columns)
    return keys.select(F.pmod(at, F.lit(SIEVE)).alias("word"), F.expr("1L").alias("one"), F.pmod(F.shiftright(at, 32), F.lit(64)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("bits"))


def sifted(rows: DataFrame, held: DataFrame, *columns: Column, among: bool = True) -> DataFrame:
    """Rows that may be among a sieve's keys, or those that are not, which need not move to be told."""
    at = F.xxhash64(*columns)
    bit = F.call_function("shiftright", held["bits"], F.pmod(F.shiftright(at, 32), F.lit(64)).cast("int")).bitwiseAND(F.expr("1L")) == 1
    return rows.join(F.broadcast(held), (F.pmod(at, F.lit(SIEVE)) == held["word"]) & bit, "left_semi" if among else "left_anti")


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """From batches of (id, text): ids as they are, nulls too, UTF-8 bytes, and int64 offsets, for whole documents of about `limit` bytes together."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0)
        text = batch.column(1).cast(pa.large_string() if not pa.types.is_binary(batch.column(1).type) else pa.large_binary())
        _, raw_offsets, raw = text.buffers()
        offsets = np.frombuffer(raw_offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield ids.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a chunk, and each document's first word (with a last entry for the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~gaps[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = word[firsts]
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] = word[lasts]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of a polynomial."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + _U(1) * (ends - starts).astype(np.uint64))


def rolling(values: np.ndarray, width: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Polynomial hash of each `width` consecutive unsigned 64-bit values, by doubling; not mixed. Shorter input: none."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out, have = np.zeros(len(values), np.uint64), 0
    part, size, todo = values, 1, width
    while todo:
        if todo & 1:
            n = len(values) - have - size + 1
            out = out[:n] * _U(pow(base, size, 1 << 64)) + part[have : have + n]
            have += size
        todo >>= 1
        if todo:
            part = part[:-size] * _U(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return out[: len(values) - width + 1]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest, by the upper 32 bits, of each `width` consecutive values, by doubling."""
    best, size = (values & _U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        best = np.minimum(best[step:], best[:-step])
        size += step
    return (best & _U(0xFFFFFFFF)).astype(np.int64)


def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows' numbers and texts of a batch of (id, text, …)."""
    return pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["row", "text"])


class Wanted:
    """Which values each row of a column of lists holds; a null list holds none."""

    def __init__(self, lists: pa.ListArray):
        sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.keys = self._key(np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        self.any = sizes > 0

    @staticmethod
    def _key(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return mix(values ^ mix(rows.astype(np.uint64) + _U(1)))

    def has(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.isin(self._key(rows, values), self.keys)


#: Values that a task deals at once, and bytes of text whose values meet in one bucket.
DEALT, BUCKET_BYTES = 1 << 18, 16 << 20
_REPEATED = "bucket long, own long, `values` array<long>, ids array<long>"


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _by_owner(ids: pa.Array, owner: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.ListArray]:
    order = np.argsort(owner, kind="stable")
    own, begins = np.unique(owner[order], return_index=True)
    return ids.take(pa.array(own)), _lists(pa.array(values[order].view(np.int64)), np.append(begins, len(order)))


def _pairs(values: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Where each pair of a value and an owner is first."""
    return np.sort(np.unique(mix(values ^ mix(ids.to_numpy().view(np.uint64))), return_index=True)[1])


def _deal(chunks, buckets: int, others: bool):
    """Rows of three kinds: what an owner holds and repeats within the task (own), values seen once with their owners (ids),
    and values that repeat within the task, once each (neither)."""

    def dealt(held: list) -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        ids = pa.concat_arrays([h[0] for h in held])
        owner = np.concatenate([h[1] + s for h, s in zip(held, shift)])
        values = np.concatenate([h[2] for h in held])
        if others:
            once = _pairs(values, ids.take(pa.array(owner)))
            owner, values = owner[once], values[once]
        distinct, first, which, times = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        again = times[which] > 1
        own, lists = _by_owner(ids, owner[again], values[again])
        none = pa.nulls(len(own), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(np.arange(len(own)) % buckets), own, lists, none], names=["bucket", "own", "values", "ids"])
        bucket = ((distinct >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)  # ascending, as the values are
        for many in (False, True):
            part = np.flatnonzero((times > 1) == many)
            which, begins = np.unique(bucket[part], return_index=True)
            bounds = np.append(begins, len(part))
            theirs = pa.nulls(len(which), pa.list_(pa.int64())) if many else _lists(ids.take(pa.array(owner[first[part]])), bounds)
            yield pa.record_batch([pa.array(which), pa.nulls(len(which), pa.int64()), _lists(pa.array(distinct[part].view(np.int64)), bounds), theirs], names=["bucket", "own", "values", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, owner, values in chunks(batches):
            held.append((ids, owner, values))
            n += len(values)
            if n >= DEALT:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    return run


def _meet(others: bool):
    """own, values: of each bucket the values that more than one row holds; rows come bucket by bucket."""

    def found(seen: list, many: list) -> pa.RecordBatch:
        values = np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in seen)])
        ids = pa.concat_arrays([pa.array([], pa.int64()), *(i for _, i in seen)])
        if others:
            once = _pairs(values, ids)
            values, ids = values[once], ids.take(pa.array(once))
        _, which, times = np.unique(values, return_inverse=True, return_counts=True)
        chosen = times[which] > 1
        if many:
            chosen |= np.isin(values, np.concatenate(many))
        code = ids.take(pa.array(np.flatnonzero(chosen))).dictionary_encode("encode")
        own, lists = _by_owner(code.dictionary, code.indices.to_numpy(), values[chosen])
        return pa.record_batch([own, lists], names=["own", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, many = None, [], []
        for batch in batches:
            direct = batch.column(1).is_valid()
            yield batch.filter(direct).select(["own", "values"])
            batch = batch.filter(pc.invert(direct))
            for at, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and seen:
                    yield found(seen, many)
                    seen, many = [], []
                now, values, ids = bucket, batch.column(2)[at].values.to_numpy().view(np.uint64), batch.column(3)[at]
                if ids.is_valid:
                    seen.append((values, ids.values))
                else:
                    many.append(values)
        if seen:
            yield found(seen, many)

    return run


def repeated(rows: DataFrame, chunks: Callable, n_bytes: int, others: bool = False) -> DataFrame:
    """own, values (array): what each owner holds of the values that occur more than once anywhere, in one owner or in several;
    `others`: in several owners only, and no id is null.

    `chunks` gives, from batches of `rows`, owners' ids, each value's place among them, and mixed 64-bit values. A task sends
    a value that it sees often but once, so a value that very many rows hold is a row per task, not per holder."""
    buckets = max(1, n_bytes // BUCKET_BYTES)
    dealt = rows.mapInArrow(_deal(chunks, buckets, others), _REPEATED)
    met = dealt.repartition(min(buckets, 1 << 16), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(others), "own long, `values` array<long>")
    return met.where("own IS NOT NULL").groupBy("own").agg(F.flatten(F.collect_list("values")).alias("values"))


def digest_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, length and text_hash (Spark's xxhash64) of every whole text."""
    return stored(docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("length"), F.xxhash64("text").alias("text_hash")), "sizes")


def exact_copies(sizes: DataFrame) -> DataFrame:
    """own, text_hash, first, copies of every document whose whole text another has too: the smallest id of the group and its
    size. A row is told by its id and its text, as rows may share an id.

    Both sides are stored, so that the join can be split where one text is very frequent, or sends the groups by true size."""
    groups = stored(sizes.groupBy("digest", "length").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    return stored(sizes.join(groups, ["digest", "length"]).select(F.col("doc_id").alias("own"), "text_hash", "first", "copies"), "copies")
