"""Media columns: texts stored as lossless 8-bit images in archives, read back by a Spark data source.

`store` writes each partition's members into one archive: PNG images, 64 grey pixels a row, then a directory of ids and
offsets, then its place. `ArchiveSource` (format "archive") plans partitions as byte ranges of the archives, by file sizes
alone. A task reads the directory of its archive, takes the members that begin within its range, and streams them in Arrow
batches of bounded size. A member that can't be read is tried again by its own offset, and after `retries` goes is returned
as a row with its error; its neighbours are not read again.

A null or empty text is stored as 64 zero bytes. Equal texts give equal members, a repeated row gives a member each, and a
null id stays one. A very long text is one member, made and read whole by one task. An empty table gives no archives' members
and an empty result; further columns are not read. A failed or repeated task writes the same archive again under the same
name. A folder without a scheme is on the file system that Spark takes it to be on (`qualified`).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import id_text, shared_dir

ROW = 64
#: Bytes of an archive that one partition reads, and of members in one Arrow batch.
RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
RETRIES = 3
_MAGIC, _PNG = b"MEDIADIR", b"\x89PNG\r\n\x1a\n"


def _piece(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(text: bytes) -> bytes:
    """A grey PNG of the bytes, padded by zeros to whole rows; the unpadded length is in a text entry."""
    rows = max(1, -(-len(text) // ROW))
    pixels = np.zeros((rows, ROW + 1), np.uint8)
    padded = np.zeros(rows * ROW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    pixels[:, 1:] = padded.reshape(rows, ROW)
    return _PNG + _piece(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _piece(b"tEXt", b"bytes\0%d" % len(text)) + _piece(b"IDAT", zlib.compress(pixels.tobytes(), 1)) + _piece(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length of an image that `to_image` made; every part's checksum is compared."""
    if image[:8] != _PNG:
        raise ValueError("not an image")
    at, parts = 8, {}
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind.decode('latin-1')} part")
        parts[kind], at = body, at + 12 + n
    width, rows = struct.unpack(">II", parts[b"IHDR"][:8])
    pixels = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    return pixels[:, 1:].tobytes(), int(parts[b"tEXt"].split(b"\0")[1])


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match("[a-z][a-z0-9+.-]*:", uri) else (pafs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, where: str) -> str:
    """The folder with its scheme, as Spark reads it: a small table is written there and asked for its files."""
    if not re.match("[a-z][a-z0-9+.-]*:", where):
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{where}/place")
        where = spark.read.parquet(f"{where}/place").inputFiles()[0].rpartition("/place/")[0]
    return re.sub("^s3[an]:", "s3:", where)


def store(docs: DataFrame, where: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the archives below `where` (a folder all nodes share) and returns the number of members; no shuffle."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(where)
        task = TaskContext.get()
        final = f"{base}/part-{task.partitionId():06d}.archive"
        ids, offsets, at = [], [0], 0
        with fs.open_output_stream(own := f"{final}.{task.taskAttemptId()}.tmp") as out:
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    image = to_image(text.as_buffer().to_pybytes())
                    out.write(image)
                    at += len(image)
                    ids.append(i)
                    offsets.append(at)
            directory = pa.record_batch([pa.array(ids, pa.int64()), pa.array(offsets[:-1], pa.int64()), pa.array(offsets[1:], pa.int64())], names=["doc_id", "begin", "end"])
            out.write(directory.schema.serialize().to_pybytes() + directory.serialize().to_pybytes())
            out.write(struct.pack("<Q", at) + _MAGIC)
        fs.move(own, final)
        yield pa.record_batch([pa.array([len(ids)], pa.int64())], names=["members"])

    where = qualified(docs.sparkSession, where)
    fs, base = _place(where)
    fs.create_dir(base, recursive=True)
    return id_text(docs, id_col, text_col).mapInArrow(write, "members long").agg(F.sum("members")).first()[0] or 0


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(folder); options range_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "doc_id long, archive string, begin long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.range_bytes, self.retries = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("retries", RETRIES))

    def partitions(self) -> list[Range]:
        fs, base = _place(self.where)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".archive"))
        return [Range(path, at, min(size, at + self.range_bytes)) for path, size in files for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, _ = _place(self.where)
        with fs.open_input_file(part.archive) as f:
            size = f.size()
            (end_of_members,) = struct.unpack("<Q", f.read_at(8, size - 16))
            directory = pa.ipc.open_stream(pa.py_buffer(f.read_at(size - 16 - end_of_members, end_of_members))).read_next_batch()
            begins, ends = (directory.column(k).to_numpy() for k in (1, 2))
            own = np.flatnonzero((begins >= part.begin) & (begins < part.end))
            ids = directory.column(0)
            while len(own):
                n = max(1, int(np.searchsorted(ends[own], begins[own[0]] + BATCH_BYTES, side="right")))
                media, errors = zip(*(self._member(f, int(begins[i]), int(ends[i])) for i in own[:n]))
                yield pa.record_batch([ids.take(pa.array(own[:n])), pa.array([part.archive] * n), pa.array(begins[own[:n]]), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "archive", "begin", "media", "error"])
                own = own[n:]

    def _member(self, f, begin: int, end: int) -> tuple[bytes | None, str | None]:
        said = ""
        for _ in range(self.retries):
            try:
                image = f.read_at(end - begin, begin)
                from_image(image)
                return image, None
            except Exception as e:  # whatever is wrong with this member, the others are read
                said = f"{type(e).__name__}: {e}"
        return None, said


def features(samples: np.ndarray) -> str:
    """64 bits in hex: whether each column is brighter than the image on average, which equal images share."""
    columns = samples.reshape(-1, ROW).sum(axis=0, dtype=np.int64)
    return np.packbits(columns * ROW > columns.sum()).tobytes().hex()


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of members as read back; a member that could not be read raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, image, error in zip(*(c.to_pylist() for c in batch.columns)):
                if error is not None:
                    raise ValueError(f"document {doc_id}: {error}")
                samples, n = from_image(image)
                rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), features(np.frombuffer(samples, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.select("doc_id", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores all texts and describes what is read back, one row per document."""
    spark: SparkSession = docs.sparkSession
    where = qualified(spark, shared_dir(spark, "media"))
    store(docs, where)
    spark.dataSource.register(ArchiveSource)
    return describe(spark.read.format("archive").load(where))
