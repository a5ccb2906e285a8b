"""Raw record buffers of snapshots and journals: one row per record.

A buffer is eight bytes (the next offset) and records behind each other, little-endian, each with its length first. Layouts
(fixed values) are those of record versions 2 and 3; other versions go, and so do names that reach out of their record. A
buffer ends at a length of zero, or at one that reaches out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: By version: least length, and where reference, parent, usn, reason, attributes, and the name's length and offset are.
LAYOUTS = {2: (60, 8, 16, 24, 40, 52, 56, 58), 3: (76, 8, 24, 40, 56, 68, 72, 74)}
REFERENCE_BITS = (1 << 48) - 1
DIRECTORY = 0x10
SCHEMA = "next long, usn long, file_reference long, parent_reference long, name string, reason long, attributes long, is_directory boolean"


def _walk(buffer: bytes) -> list[int]:
    """Where the buffer's records begin, and the end of the last."""
    at, begins = 8, []
    while at + 4 <= len(buffer):
        size = int.from_bytes(buffer[at : at + 4], "little")
        if not size or at + size > len(buffer):
            break
        begins.append(at)
        at += size
    return [*begins, at] if begins else []


def _numbers(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return data[at[:, None] + np.arange(width)].copy().view(f"<u{width}").ravel()


def _records(buffers: list[bytes]) -> Iterator[pa.RecordBatch]:
    """All records of some buffers, field by field."""
    data, shift, rows = np.frombuffer(b"".join(buffers), np.uint8), 0, []
    for buffer in buffers:
        places = np.array(_walk(buffer), np.int64)
        if len(places):
            following = int.from_bytes(buffer[:8], "little", signed=True)
            rows.append(np.stack([places[:-1] + shift, np.diff(places), np.full(len(places) - 1, following)], axis=1))
        shift += len(buffer)
    rows = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    rows = rows[rows[:, 1] >= LAYOUTS[2][0]]
    version = _numbers(data, rows[:, 0] + 4, 2)
    for kind, (least, *fields) in LAYOUTS.items():
        begin, size, following = rows[(version == kind) & (rows[:, 1] >= least)].T
        ref, parent, usn, reason, attributes, n, offset = (_numbers(data, begin + f, w) for f, w in zip(fields, (8, 8, 8, 4, 4, 2, 2)))
        good = offset.astype(np.int64) + n <= size
        names = [data[a : a + k].tobytes().decode("utf-16-le", "replace") for a, k in zip((begin + offset)[good].tolist(), (n[good] // 2 * 2).tolist())]
        number = lambda x, good=good: pa.array(x[good].astype(np.int64))
        mask = np.uint64(REFERENCE_BITS)
        yield pa.record_batch([number(following), number(usn.view(np.int64)), number(ref & mask), number(parent & mask), pa.array(names, pa.string()), number(reason), number(attributes), pa.array((attributes[good] & DIRECTORY) != 0)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for buffer in batch.column(0):
            if buffer.is_valid and len(buffer.as_buffer()) >= 8:
                held.append(buffer.as_buffer().to_pybytes())
                size += len(held[-1])
            if size >= 4 << 20:
                yield from _records(held)
                held, size = [], 0
        if held:
            yield from _records(held)


def decode_record_buffers(buffers: DataFrame, column: str = "buffer", snapshot: bool = False) -> DataFrame:
    """One row per record of a table of buffers, in one pass and without a shuffle. `snapshot`: only real entries, which have
    a reference from 24 on and a name, as tree snapshots hold; a journal's records are all kept. Null buffers hold none."""
    found = buffers.select(column).mapInArrow(_decode, SCHEMA)
    return found.where((F.col("file_reference") >= 24) & (F.col("name") != "")) if snapshot else found
