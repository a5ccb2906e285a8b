"""A catalog in versions, volume by volume.

The rows of a volume lie in a folder that is written once. A version is one small file that names the folder of each volume,
how far the volume's change log has been applied, and the last batch of each stream that writes here. It is drafted under
another name and then renamed to its number, which fails where a file of that number is: of two writers that begin at one
version the second gets `Conflict`, and rows, offsets and batch numbers become visible together or not at all. Folders of
writers that failed are named by no version.

A change writes the volumes that it touches; the others' folders go on into the new version. Rows are stored with their names
and paths folded (`name_lc`, `path_lc`), in ranges of volume and folded name, with bloom filters, so that equality on either
reads few row groups. Renaming is as atomic as the file system makes it: HDFS does, object stores need a committer that does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.paths import ascii_lower
from ..operators.maintain import SMALL, row_bytes, upsert

FOLDED = ("name_lc", "path_lc")


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    offsets: dict[int, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class CatalogStore:
    """Versions of a table of `schema` (with volume_id, name, full_path) below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, where: str, schema: StructType):
        self.spark, self.where, self.schema = spark, where.rstrip("/"), StructType([f for f in schema if f.name not in FOLDED])

    # --- versions

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, fs = self._path("versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def version(self, number: int) -> Version:
        path, fs = self._path(f"versions/{number:012d}.json")
        stream = fs.open(path)
        try:
            x = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        numbered = lambda d: {int(k): v for k, v in d.items()}
        return Version(number, numbered(x["folders"]), numbered(x["offsets"]), x["batches"])

    def head(self) -> Version:
        """The last version; number 0, without rows, before the first."""
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else Version()

    def _publish(self, version: Version) -> None:
        name = f"versions/{version.number:012d}.json"
        draft, fs = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"folders": version.folders, "offsets": version.offsets, "batches": version.batches}).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(self._path(name)[0]), plain)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version.number} is there already") from None
            raise

    # --- rows

    def _stored(self) -> StructType:
        volume = self.schema["volume_id"]
        return StructType([*(f for f in self.schema if f.name != "volume_id"), *(StructField(c, StringType()) for c in FOLDED), volume])

    def read(self, version: Version | None = None, volumes: Iterable[int] | None = None, folded: bool = False) -> DataFrame:
        """The rows of a version (the last), of some volumes (all); `folded`: with name_lc and path_lc."""
        version = version or self.head()
        names = [*self.schema.names, *(FOLDED if folded else ())]
        folders = [f for v, f in sorted(version.folders.items()) if volumes is None or v in set(volumes)]
        if not folders:
            return self.spark.createDataFrame([], StructType([*self.schema, *(StructField(c, StringType()) for c in FOLDED)])).select(*names)
        return self.spark.read.schema(self._stored()).option("basePath", f"{self.where}/rows").parquet(*(f"{self.where}/rows/{f}" for f in folders)).select(*names)

    def offsets(self, version: Version | None = None) -> DataFrame:
        """volume_id, last_usn: how far each volume's log has been applied."""
        return self.spark.createDataFrame(sorted((version or self.head()).offsets.items()), "volume_id long, last_usn long")

    def write(self, rows: DataFrame) -> dict[int, str]:
        """Writes rows to a new folder for each volume; no version names them yet."""
        written = f"written={uuid.uuid4().hex}"
        laid = rows.select(*self.schema.names).withColumn("name_lc", ascii_lower(F.col("name"))).withColumn("path_lc", ascii_lower(F.col("full_path")))
        out = laid.repartitionByRange("volume_id", "name_lc").sortWithinPartitions("volume_id", "name_lc").write.partitionBy("volume_id")
        for c in FOLDED:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.where}/rows/{written}")
        path, fs = self._path(f"rows/{written}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {int(n.partition("=")[2]): f"{written}/{n}" for n in names if n.startswith("volume_id=")}

    def commit(self, base: Version, rows: DataFrame | None, touched: Iterable[int], offsets: dict[int, int] | None = None, batches: dict[str, int] | None = None) -> Version:
        """Publishes what follows `base`: for the touched volumes the given rows (none: the volume goes), the others as they are.
        Offsets never go back."""
        touched = set(touched)
        new = self.write(rows.where(F.col("volume_id").isin(sorted(touched)))) if rows is not None and touched else {}
        folders = {v: f for v, f in base.folders.items() if v not in touched} | new
        moved = {v: max(n, base.offsets.get(v, n)) for v, n in (offsets or {}).items()}
        after = Version(base.number + 1, folders, base.offsets | moved, base.batches | (batches or {}))
        self._publish(after)
        return after

    # --- changes of a volume

    def replace(self, rows: DataFrame, base: Version | None = None) -> Version:
        """All rows anew."""
        base = base or self.head()
        new = self.write(rows)
        after = Version(base.number + 1, new, base.offsets, base.batches)
        self._publish(after)
        return after

    def upsert(self, delta: DataFrame, keep: tuple[str, ...] = (), base: Version | None = None) -> Version:
        """Rows by path over those that are there; reads and writes only the volumes of `delta`, whose size decides whether it
        goes to their rows or both are dealt by path."""
        base, delta = base or self.head(), delta.select(*self.schema.names)
        sizes = {r[0]: r[1] for r in delta.groupBy("volume_id").agg(F.sum(row_bytes(delta))).collect()}  # a row for each volume
        return self.commit(base, upsert(self.read(base, sizes), delta, "full_path", keep, sum(sizes.values()) <= SMALL), sizes)

    def delete_volume(self, volume_id: int, base: Version | None = None) -> Version:
        """Drops a volume's folder from the next version; no rows are read or written."""
        return self.commit(base or self.head(), None, [volume_id])
