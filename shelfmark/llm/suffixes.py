"""Substring de-duplication on bytes by suffix arrays.

Only windows of `length` bytes that can repeat are sorted: each window has an anchor, the smallest hash of its `gram` bytes,
which equal windows share, and anchors that occur once anywhere rule their windows out, exactly. The windows of one anchor's
place are neighbours and make one piece of text; equal pieces are counted, not sent again, and of texts with exact copies
only the first is looked at. Pieces go to shards by anchor, so equal windows meet in one shard. An anchor with very many
different pieces is spread: its pieces are halved by how far behind a window's start the anchor is, and each half has what
its windows have in common for an anchor, until few differ. A shard's pieces are joined, with a separator after each, in a
file, and sorted by external induced sorting (`induced`), which carries what neighbours share: a window that shares `length`
bytes with a neighbour repeats.

A null text is an empty one; texts shorter than a window keep all bytes; a very long text is a step of its own. Rows without
an id keep all bytes. Repeated rows are copies of each other and get a row each. An empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, Wanted, digest_sizes, exact_copies, id_text, mix, numbered, repeated, rolling, sliding_argmin, stored, text_chunks
from .induced import scratch, shared_neighbours

LENGTH, GRAM = 200, 48
#: Bytes of texts for each shard, of which pieces are a part; bytes of tuples that the queues of a shard hold in memory.
SHARD, QUEUES = 3 << 20, 256 << 10
#: Distinct pieces of an anchor that stay together.
HEAVY = 4096


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows of one anchor's place: document, first start in the chunk, number of windows, hash of the anchor, and
    how far behind the first start it is."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
    if not len(doc):
        return doc, doc, doc, np.zeros(0, np.uint64), doc
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count - offsets[:-1], count)
    grams = mix(rolling(_BYTES[data], gram))
    where = sliding_argmin(grams, length - gram + 1)[begin]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], begin[heads], np.diff(np.append(heads, len(where))), grams[where[heads]], where[heads] - begin[heads]


def _anchors(length: int, gram: int):
    """Chunks of values for `repeated`: each document's anchors."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for ids, data, offsets in text_chunks(batches, 1 << 20):
            doc, _, _, anchor, _ = _runs(data, offsets, length, gram)
            yield ids, doc.astype(np.int64), anchor

    return chunks


def _pieces(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(Wanted(batch.column(2)).any))
            wanted = Wanted(batch.column(2))
            for rows, data, offsets in text_chunks([numbered(batch)], 1 << 20):
                rows = rows.to_numpy()
                doc, begin, n, anchor, place = _runs(data, offsets, length, gram)
                own = np.flatnonzero(wanted.has(rows[doc], anchor))
                text = data.tobytes()
                pieces = [text[b : b + m + length - 1] for b, m in zip(begin[own].tolist(), n[own].tolist())]
                same = lambda x, k=len(own): pa.array(np.full(k, x, np.int32))
                yield pa.record_batch([batch.column(0).take(pa.array(rows[doc[own]])), pa.array(begin[own] - offsets[doc[own]], pa.int32()), pa.array(anchor[own].view(np.int64)), pa.array(place[own], pa.int32()), same(0), same(length - gram), pa.array(pieces, pa.binary())], names=PIECE_NAMES)

    return run


PIECE = "doc_id long, start int, anchor long, place int, low int, high int, piece binary"
PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _halves(length: int):
    """Cuts pieces in two by how far behind a window's start the anchor is, from `low` to `high`. All windows of a half hold
    what lies around the anchor between the last start and the first end, which is their new anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, start, place, low, high, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "place", "low", "high", "piece"))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(0, place - b), min(len(piece) - length, place - a)
                    if first <= last:
                        core = xxhash.xxh3_64_intdigest(piece[place - a : place - b + length], seed=a * length + b)
                        rows.append((doc_id, start + first, core - (core >> 63 << 64), place - first, a, b, piece[first : last + length]))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=PIECE_NAMES)

    return run


def _spread(pieces: DataFrame, length: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Places (doc_id, start, key) and distinct pieces (anchor, piece, key, n). The pieces of an anchor that has more than
    `heavy` distinct ones are halved, again and again: equal windows stay together, others part where they differ."""
    key = F.unhex(F.concat(F.md5("piece"), F.lpad(F.hex("anchor"), 16, "0")))
    places, distinct = [], []
    while True:
        pieces = stored(pieces.withColumn("key", key), "pieces")
        found = stored(pieces.groupBy("anchor", "piece", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("high") - F.col("low")).alias("wide")), "distinct")
        many = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("wide").alias("wide")).where((F.col("k") > heavy) & (F.col("wide") > 0)).select("anchor"), "heavy")
        places.append(pieces.join(many, "anchor", "left_anti").select("doc_id", "start", "key"))
        distinct.append(found.join(many, "anchor", "left_anti").select("anchor", "piece", "key", "n"))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, places), reduce(DataFrame.unionByName, distinct)
        pieces = pieces.join(many, "anchor", "left_semi").select(*PIECE_NAMES).mapInArrow(_halves(length), PIECE)


def _sort_shards(length: int):
    def shard(pieces: list[int], copies: list[int], keys: list[bytes], file) -> pa.RecordBatch:
        size = np.array(pieces, np.int64)
        begin = np.cumsum(size + 1) - size - 1
        file.flush()
        text = np.memmap(file, np.int16, "r", shape=(int((size + 1).sum()) + 1,))
        repeats = shared_neighbours(text, 258, length, QUEUES).astype(np.int64)
        owner = np.searchsorted(begin, repeats, side="right") - 1
        inside = repeats - begin[owner] <= size[owner] - length
        repeats, owner = repeats[inside], owner[inside]
        flagged = np.zeros(len(text) + 1, bool)
        flagged[repeats] = True
        for i in np.flatnonzero(np.array(copies) > 1):
            flagged[begin[i] : begin[i] + size[i] - length + 1] = True
        edge = np.flatnonzero(np.diff(flagged.astype(np.int8), prepend=0))
        starts, stops = edge[::2], edge[1::2]
        owner = np.searchsorted(begin, starts, side="right") - 1
        return pa.record_batch([pa.array([keys[i] for i in owner], pa.binary()), pa.array(starts - begin[owner], pa.int32()), pa.array(stops - starts, pa.int32())], names=["key", "from", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes, copies, keys, file = None, [], [], [], tempfile.TemporaryFile(dir=scratch())
        for batch in batches:
            for s, piece, n, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if s != now and sizes:
                    file.write(b"\0\0")
                    yield shard(sizes, copies, keys, file)
                    sizes, copies, keys = [], [], []
                    file.seek(0)
                    file.truncate()
                now = s
                symbols = np.frombuffer(piece.as_buffer(), np.uint8).astype(np.int16)
                file.write((symbols + 2).tobytes() + b"\1\0")
                sizes.append(len(symbols))
                copies.append(n)
                keys.append(key)
        if sizes:
            file.write(b"\0\0")
            yield shard(sizes, copies, keys, file)
        file.close()

    return run


def repeated_spans(docs: DataFrame, later: DataFrame, n_bytes: int, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, heavy: int = HEAVY) -> DataFrame:
    """doc_id, start, windows: runs of window starts, in bytes, whose windows occur elsewhere too. Of copies only the first
    takes part: `later` (own, own_hash) lists the others."""
    firsts = docs.join(later, (docs["doc_id"] == later["own"]) & (F.xxhash64("text") == later["own_hash"]), "left_anti")
    known = stored(repeated(firsts, _anchors(length, gram), n_bytes), "anchors")
    candidates = docs.join(known, docs["doc_id"] == known["own"]).select("doc_id", "text", "values")
    places, distinct = _spread(candidates.mapInArrow(_pieces(length, gram), PIECE), length, heavy)
    shards = max(1, -(-n_bytes // shard))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select("shard", "piece", "n", "key")
    runs = stored(dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_sort_shards(length), "key binary, `from` int, windows int"), "runs")
    return places.join(runs, "key").select("doc_id", (F.col("start") + F.col("from")).alias("start"), "windows")


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                text = text.as_buffer().to_pybytes()
                if copy and len(text) >= length:
                    rows.append((len(text), len(text), 1, b""))
                    continue
                if not spans.is_valid:
                    rows.append((len(text), 0, 0, text))
                    continue
                edges = np.zeros(len(text) + 1, np.int32)
                start, windows = (spans.values.field(k).to_numpy() for k in (0, 1))
                np.add.at(edges, start, 1)
                np.add.at(edges, start + windows + (length - 1), -1)
                gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
                begins = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), len(text) - len(kept), begins, kept))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    rows = id_text(docs)
    sizes = digest_sizes(rows)
    copies = exact_copies(sizes)
    later = stored(copies.where("own <> first").select("own", F.col("text_hash").alias("own_hash")).distinct(), "later")
    n_bytes = sizes.agg(F.sum("length")).first()[0] or 0
    spans = repeated_spans(rows, later, n_bytes, length, gram, heavy=heavy).groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    spans = stored(spans, "spans")
    copied = stored(copies.select(F.col("own").alias("copied"), F.col("text_hash").alias("own_hash")).distinct(), "copied")
    whole = rows.join(spans, rows["doc_id"] == spans["own"], "left").join(copied, (F.col("doc_id") == F.col("copied")) & (F.xxhash64("text") == F.col("own_hash")), "left")
    return whole.select("doc_id", "text", "spans", F.col("copied").isNotNull().alias("copy")).mapInArrow(_keep(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
