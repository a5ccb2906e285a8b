"""Substring de-duplication on words by De Bruijn compaction.

Windows of `length` words are the edges of a De Bruijn graph. Each window has an anchor, the smallest hash of its `gram`
words, which equal windows share; anchors that occur once anywhere rule their windows out, exactly. Of texts with exact
copies only the first makes edges. The windows of one anchor's place follow each other and travel as one piece, and equal
pieces are one, with their first place: in all other places the whole piece repeats. The edges of the distinct pieces are
then counted, with their first place and what goes before them. An edge all of whose occurrences follow the same edge, as
often as that occurs, is inside a nonbranching path. A join of the edges with themselves by source coordinates finds those,
so paths compact to their first edges, and only these are joined with the occurrences: a row is then a repeated span with
its source. Spans and sources are read at their coordinates once more and compared by a second, independent hash before
anything is removed.

A null text is an empty one. Texts shorter than a window keep all words; a very long text is a step of its own. Rows without
an id keep all words. Repeated rows are one document and get a row each; different texts under one id are taken for one
document too. An empty table gives an empty result; further columns are not read. Hashes are of 64 bits; words of over 1,023
bytes that are made to collide could hide a repeat, never remove what is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Wanted, digest_sizes, exact_copies, forget, id_text, mix, numbered, repeated, rolling, sliding_argmin, span_hashes, stored, text_chunks, word_bounds

LENGTH, GRAM = 20, 8


def _windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Of a chunk: hashes of words, first word of each document, starts of all whole windows, their documents, hash of each
    start's anchor, and where that is."""
    starts, ends, first = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    count = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count - first[:-1], count)
    grams = mix(rolling(words, gram))
    where = sliding_argmin(grams, length - gram + 1)[begin] if len(begin) else begin
    return starts, ends, words, first, begin, doc, (grams[where] if len(begin) else np.zeros(0, np.uint64)), where


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows of one anchor's place: document, first word in it, number of windows, anchor; and all edges in order."""
    _, _, words, first, begin, doc, anchor, where = _windows(data, offsets, length, gram)
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    edges = mix(rolling(words, length))[begin] if len(begin) else np.zeros(0, np.uint64)
    return doc[heads], begin[heads] - first[doc[heads]], np.diff(np.append(heads, len(where))), anchor[heads], edges, heads


def _anchors(length: int, gram: int):
    """Chunks of values for `repeated`: each document's anchors."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for ids, data, offsets in text_chunks(batches):
            doc, _, _, anchor, *_ = _runs(data, offsets, length, gram)
            yield ids, doc, anchor

    return chunks


def _pieces(length: int, gram: int):
    """Pieces whose anchor repeats: place, number of windows, identity, and their edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = Wanted(batch.column(2))
            batch = batch.filter(pa.array(wanted.any))
            wanted = Wanted(batch.column(2))
            for rows, data, offsets in text_chunks([numbered(batch)]):
                rows = rows.to_numpy()
                doc, start, n, anchor, edges, heads = _runs(data, offsets, length, gram)
                own = np.flatnonzero(wanted.has(rows[doc], anchor))
                powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(n.max(initial=1)), 0xC2B2AE3D27D4EB4F, np.uint64)))
                sums = np.add.reduceat(edges * powers[np.arange(len(edges)) - np.repeat(heads, n)], heads) if len(heads) else np.zeros(0, np.uint64)
                identity = mix(sums + n.astype(np.uint64))
                chosen = np.zeros(len(heads), bool)
                chosen[own] = True
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[own])), pa.int32()), pa.array(edges[np.repeat(chosen, n)].view(np.int64)))
                yield pa.record_batch([batch.column(0).take(pa.array(rows[doc[own]])), pa.array(start[own], pa.int32()), pa.array(n[own], pa.int32()), pa.array(identity[own].view(np.int64)), lists], names=["doc_id", "start", "windows", "piece", "edges"])

    return run


def _edge_values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Chunks of values for `repeated`: the edges of pieces (piece, edges)."""
    for batch in batches:
        edges = batch.column(1)
        yield batch.column(0), np.repeat(np.arange(batch.num_rows), edges.value_lengths().to_numpy()), edges.flatten().to_numpy().view(np.uint64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces (s_doc, s_start, edges, wanted): the wanted edges with their places and the edges before them."""
    for batch in batches:
        wanted = Wanted(batch.column(3))
        n = batch.column(2).value_lengths().to_numpy()
        row, edges = np.repeat(np.arange(len(n)), n), batch.column(2).flatten().to_numpy()
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = np.flatnonzero(wanted.has(row, edges.view(np.uint64)))
        before = pa.array(np.append(0, edges[:-1])[own], mask=i[own] == 0)
        start = batch.column(1).to_numpy()[row[own]] + i[own]
        yield pa.record_batch([batch.column(0).take(pa.array(row[own])), pa.array(start, pa.int32()), pa.array(edges[own]), before], names=["doc_id", "start", "edge", "before"])


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A second hash of the words at each of the wanted coordinates of a document."""
    for batch in batches:
        for at in range(batch.num_rows):
            wanted = batch.column(2)[at].values
            words = batch.column(1)[at].as_py().encode().split()
            begin, size = wanted.field(0), wanted.field(1)
            check = b"".join(hashlib.blake2b(b" ".join(words[s : s + n]), digest_size=8).digest() for s, n in zip(begin.to_pylist(), size.to_pylist()))
            ids = pa.repeat(batch.column(0)[at], len(begin))
            yield pa.record_batch([ids, begin, size, pa.array(np.frombuffer(check, "<i8"))], names=["doc_id", "start", "words", "check"])


def repeated_spans(docs: DataFrame, later: DataFrame, n_bytes: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start, words: spans of words whose windows all start earlier too. `docs`: doc_id, text; `later` (own, own_hash):
    copies, which are left out. Every step is stored, so that shuffle files go when it ends."""
    firsts = docs.join(later, (docs["doc_id"] == later["own"]) & (F.xxhash64("text") == later["own_hash"]), "left_anti")
    known = stored(repeated(firsts, _anchors(length, gram), n_bytes), "anchors")
    candidates = docs.join(known, docs["doc_id"] == known["own"]).select("doc_id", "text", "values")
    pieces = stored(candidates.mapInArrow(_pieces(length, gram), "doc_id long, start int, windows int, piece long, edges array<long>"), "pieces")
    first = pieces.groupBy("piece").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.first("edges").alias("edges"))
    first = stored(first.select("piece", F.col("source.doc_id").alias("s_doc"), F.col("source.start").alias("s_start"), "edges"), "first-pieces")
    again = pieces.select("doc_id", "start", (F.col("windows") + (length - 1)).alias("words"), "piece").join(first.select("piece", "s_doc", "s_start"), "piece").where("doc_id <> s_doc OR start <> s_start")
    often = stored(repeated(first.select("piece", "edges"), _edge_values, n_bytes), "edges")
    edges = first.join(often, first["piece"] == often["own"]).select("s_doc", "s_start", "edges", "values").mapInArrow(_steps, "doc_id long, start int, edge long, before long")
    edges = stored(edges, "edges")
    forget(known)
    counted = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("source"), F.min("before").alias("before"), F.max("before").alias("other"), F.count("before").alias("led"))
    repeats = stored(counted.select("edge", "n", F.col("source.doc_id").alias("s_doc"), F.col("source.start").alias("s_start"), "before", ((F.col("before") == F.col("other")) & (F.col("led") == F.col("n"))).alias("one_way")), "edges")
    ahead = repeats.select(F.col("s_doc").alias("p_doc"), (F.col("s_start") + 1).alias("p_next"), F.col("n").alias("p_n"), F.col("edge").alias("p_edge"))
    inside = F.coalesce(F.col("one_way") & (F.col("p_n") == F.col("n")) & (F.col("p_edge") == F.col("before")), F.lit(False))
    joined = repeats.join(ahead, (F.col("s_doc") == F.col("p_doc")) & (F.col("s_start") == F.col("p_next")), "left").select("edge", "s_doc", "s_start", inside.alias("inside"))
    along = Window.partitionBy("s_doc").orderBy("s_start")
    numbers = joined.withColumn("path", F.sum((~F.col("inside")).cast("int")).over(along))
    paths = stored(numbers.groupBy("s_doc", "path").agg(F.min("s_start").alias("s_start"), F.count(F.lit(1)).cast("int").alias("edges"), F.min_by("edge", "s_start").alias("edge")), "paths")
    partly = edges.select("doc_id", "start", "edge").join(paths, "edge").where("doc_id <> s_doc OR start <> s_start")
    columns = ["doc_id", "start", "words", "s_doc", "s_start"]
    spans = stored(again.select(columns).unionByName(partly.select("doc_id", "start", (F.col("edges") + (length - 1)).alias("words"), "s_doc", "s_start")), "spans")
    forget(pieces, first, often, edges, repeats, paths)
    wanted = spans.select("doc_id", "start", "words").unionByName(spans.select(F.col("s_doc").alias("doc_id"), F.col("s_start").alias("start"), "words")).distinct()
    asked = stored(wanted.groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct("start", "words")).alias("asked")), "asked")
    checks = stored(docs.join(asked, docs["doc_id"] == asked["own"]).select("doc_id", "text", "asked").mapInArrow(_checks, "doc_id long, start int, words int, check long").distinct(), "checks")
    source = checks.select(F.col("doc_id").alias("s_doc"), F.col("start").alias("s_start"), "words", F.col("check").alias("s_check"))
    return spans.join(checks, ["doc_id", "start", "words"]).join(source, ["s_doc", "s_start", "words"]).where("check = s_check").select("doc_id", "start", "words")


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, copy in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                words = text.encode().split()
                if copy and len(words) >= length:
                    kept = []
                elif spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    start, size = (spans.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                else:
                    kept = words
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every document."""
    rows = id_text(docs)
    sizes = digest_sizes(rows)
    later = stored(exact_copies(sizes).where("own <> first").select("own", F.col("text_hash").alias("own_hash")).distinct(), "later")
    n_bytes = sizes.agg(F.sum("length")).first()[0] or 0
    spans = repeated_spans(rows, later, n_bytes, length, gram).groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    spans = stored(spans, "spans")
    whole = rows.join(spans, rows["doc_id"] == spans["own"], "left").join(later.select(F.col("own").alias("later"), "own_hash"), (F.col("doc_id") == F.col("later")) & (F.xxhash64("text") == F.col("own_hash")), "left")
    return whole.select("doc_id", "text", "spans", F.col("later").isNotNull().alias("copy")).mapInArrow(_keep(length), "doc_id long, n_words long, n_removed long, kept string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
