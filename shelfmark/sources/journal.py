"""Change logs by volume: batch reads from a table of offsets, and a streaming data source whose offset is a map.

Each volume counts its own sequence numbers (usn), so an offset is a number for each volume. A log is a folder of Parquet
files, `volume_id=N/…`; files of a volume may overlap in usn, and none is changed once written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHANGES = "volume_id long, usn long, ts timestamp, file_reference long, parent_reference long, name string, reason long, is_directory boolean"
_ARROW = pa.schema([("volume_id", pa.int64()), ("usn", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("file_reference", pa.int64()), ("parent_reference", pa.int64()), ("name", pa.string()), ("reason", pa.int64()), ("is_directory", pa.bool_())])


def since(changes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Changes after their volume's offset (volume_id, last_usn); all of a volume that has none. Offsets are a row for each
    volume, a small dimension."""
    o = offsets.select("volume_id", F.col("last_usn").alias("_after"))
    return changes.join(o, "volume_id", "left").where(F.col("_after").isNull() | (F.col("usn") > F.col("_after"))).select(*changes.columns)


def read_change_log(changes: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each volume's log holds after its offset, and the offsets to read from next: the largest usn read, or the old one."""
    rows = since(changes, offsets)
    last = rows.groupBy("volume_id").agg(F.max("usn").alias("_last"))
    after = offsets.select("volume_id", "last_usn").join(last, "volume_id", "full_outer").select("volume_id", F.coalesce("_last", "last_usn").alias("last_usn"))
    return rows, after


@dataclass
class LogRange(InputPartition):
    """A file's row groups that may hold usns of a volume above `low` and up to `high`."""

    volume: int
    path: str
    groups: list[int]
    low: int
    high: int


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, path: str, start: dict[str, int]):
        self.path, self.start, self.spans = path, start, {}

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if re.match("[a-z][a-z0-9+.-]*:", self.path) else (pafs.LocalFileSystem(), self.path)

    def _groups(self) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
        """volume, file, and the first and last usn of each of its row groups; footers are read once for each file."""
        fs, root = self._fs()
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            volume = re.search(r"/volume_id=(\d+)/[^/]*\.parquet$", f.path)
            if not volume or "/_" in f.path.removeprefix(root):
                continue
            if f.path not in self.spans:
                with fs.open_input_file(f.path) as file:
                    meta = pq.ParquetFile(file).metadata
                    column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "usn")
                    stats = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
                    self.spans[f.path] = [(s.min, s.max) for s in stats]
            yield int(volume[1]), f.path, self.spans[f.path]

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        last = dict(self.start)
        for volume, _, spans in self._groups():
            last[str(volume)] = max([last.get(str(volume), -1), *(hi for _, hi in spans)])
        return last

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        planned = []
        for volume, path, spans in sorted(self._groups()):
            low, high = start.get(str(volume), self.start.get(str(volume), -1)), end.get(str(volume), -1)
            groups = [g for g, (lo, hi) in enumerate(spans) if hi > low and lo <= high]
            if groups:
                planned.append(LogRange(volume, path, groups, low, high))
        return planned

    def read(self, part: LogRange) -> Iterator[pa.RecordBatch]:
        fs, _ = self._fs()
        with fs.open_input_file(part.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=10_000, row_groups=part.groups):
                table = pa.Table.from_batches([batch]).append_column("volume_id", pa.array([part.volume] * batch.num_rows, pa.int64()))
                usn = pads.field("usn")
                kept = table.filter((usn > part.low) & (usn <= part.high))
                yield from pa.table([_as(kept[f.name], f.type) for f in _ARROW], schema=_ARROW).to_batches()


def _as(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """Times without a zone are UTC."""
    if pa.types.is_timestamp(kind) and column.type.tz is None:
        return column.cast(pa.timestamp("us")).cast(kind)
    return column.cast(kind)


class ChangeLog(DataSource):
    """`spark.readStream.format("change_log").option("since", '{"1": 320000}').load(folder)` after `spark.dataSource.register(ChangeLog)`.
    A batch's offsets are kept by the stream's checkpoint, so each volume resumes where it stood, and a planned batch that is
    run again reads the same ranges."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(self.options["path"], {str(k): int(v) for k, v in json.loads(self.options.get("since", "{}")).items()})
