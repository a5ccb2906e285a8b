"""The catalog's tables: schemas, reads, and the views that derive a catalog from star-schema tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import clamp_size, known_time, parent_path, volume_type_norm
from ..session import cut, shared_dir, write_by_volume

FILES = "id long, volume_id long, parent_id long, name string, full_path string, is_directory boolean, size long, created_time timestamp, modified_time timestamp, mft_reference long"
VOLUMES = "id long, serial_number string, label string, mount_point string, volume_type string, last_scan_time timestamp, last_usn long, is_online boolean"
RECORDS = "volume_id long, file_reference long, parent_reference long, name string, attributes long, size long"

TABLES = ("region", "nation", "customer", "orders", "events", "pages")

#: Views in order; each may name those before it, in braces. One text for both engines, but for what `_BESIDE` has.
VIEWS = {
    "volumes": """SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, concat('SER', r_regionkey) AS serial_number,
      CASE WHEN r_regionkey = 4 THEN NULL ELSE r_name END AS label, concat(chr(67 + r_regionkey), ':') AS mount_point,
      CASE r_regionkey % 4 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'local' WHEN 2 THEN 'network' ELSE 'removable' END AS volume_type,
      r_regionkey <> 4 AS is_online, CAST(r_regionkey * 1000 AS BIGINT) AS last_usn, CAST(NULL AS TIMESTAMP) AS last_scan_time FROM {region}""",
    "mft": """SELECT CAST(24 + n_nationkey AS BIGINT) AS file_reference, CAST(5 AS BIGINT) AS parent_reference, n_name AS name, TRUE AS is_directory,
      CAST(0 AS BIGINT) AS size, CAST(NULL AS TIMESTAMP) AS created_time, CAST(n_regionkey + 1 AS BIGINT) AS volume_id FROM {nation}
      UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CAST(24 + c_nationkey AS BIGINT), c_name, TRUE, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(n_regionkey + 1 AS BIGINT)
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
      UNION ALL SELECT CAST(1000000000 + o_orderkey AS BIGINT), CAST(1000 + o_custkey AS BIGINT),
      concat(CASE WHEN o_orderkey % 7 = 0 THEN upper(st) ELSE st END, '_', o_orderkey % 13, ext), FALSE,
      CAST(floor(o_totalprice) AS BIGINT), CAST(o_orderdate AS TIMESTAMP), CAST(n_regionkey + 1 AS BIGINT)
      FROM (SELECT *, concat(CASE o_orderkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'old' WHEN 2 THEN 'Annual' ELSE '.tmp' END,
        CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '.' ELSE '' END,
        CASE o_orderkey % 5 WHEN 0 THEN 'ring' WHEN 1 THEN 'report' WHEN 2 THEN 'plate' WHEN 3 THEN 'rod' ELSE 'log' END) AS st,
        CASE o_orderpriority WHEN '1-URGENT' THEN '.txt' WHEN '2-HIGH' THEN '.pdf' WHEN '3-MEDIUM' THEN '.tar.gz' WHEN '5-LOW' THEN '.mp4' ELSE '' END AS ext FROM {orders}) o
      JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "scan_entries": """SELECT f.file_reference AS mft_reference, f.volume_id, f.name, f.is_directory, f.size, f.created_time,
      concat(chr(CAST(66 + f.volume_id AS INT)), ':', chr(92), CASE WHEN g.name IS NULL THEN '' ELSE concat(g.name, chr(92)) END,
        CASE WHEN p.name IS NULL THEN '' ELSE concat(p.name, chr(92)) END, f.name) AS full_path
      FROM {mft} f LEFT JOIN {mft} p ON f.parent_reference = p.file_reference LEFT JOIN {mft} g ON p.parent_reference = g.file_reference""",
    "files": """SELECT mft_reference, volume_id, name, is_directory, size, created_time, full_path FROM (
      SELECT *, row_number() OVER (PARTITION BY full_path ORDER BY mft_reference DESC) AS rn FROM {scan_entries}) x WHERE rn = 1""",
    "changes": """SELECT CAST(event_id * 64 AS BIGINT) AS usn, ts, CAST(event_id % 5 + 1 AS BIGINT) AS volume_id, CAST(1000000000 + user_id AS BIGINT) AS file_reference, CAST(CASE event_id % 10 WHEN 0 THEN 5 WHEN 1 THEN 999999 ELSE 1000 + user_id END AS BIGINT) AS parent_reference,
      concat('user_', user_id, '.log') AS name,
      CAST(CASE event_type WHEN 'signup' THEN 256 WHEN 'click' THEN 2 WHEN 'purchase' THEN 8192 WHEN 'error' THEN 512 ELSE 2147483648 END AS BIGINT) AS reason,
      FALSE AS is_directory FROM {events}""",
    "tree_changes": """SELECT CAST(event_id * 64 + 3 - level AS BIGINT) AS usn, ts, CAST(event_id % 5 + 1 AS BIGINT) AS volume_id, CAST(2000000000 AS BIGINT) + level * 100000000 + event_id AS file_reference,
      CAST(CASE WHEN level > 0 THEN CAST(1900000000 AS BIGINT) + level * 100000000 + event_id WHEN event_id % 4 = 0 THEN 5 ELSE 1000 + user_id END AS BIGINT) AS parent_reference,
      concat(CASE level WHEN 0 THEN 'new' WHEN 1 THEN 'deep' ELSE 'in.' END, '_', event_id) AS name, CAST(CASE WHEN event_type = 'click' THEN 8192 ELSE 256 END AS BIGINT) AS reason, level < 2 AS is_directory
      FROM {events}, (SELECT 0 AS level UNION ALL SELECT 1 UNION ALL SELECT 2) l WHERE event_id % 7 = 0""",
    "unc_paths": """SELECT page_id, concat(chr(92), chr(92), replace(regexp_replace(url, '^https?://', ''), '/', chr(92))) AS full_path FROM {pages}""",
    "listing": """SELECT full_path, is_directory, size FROM {files} WHERE NOT (NOT is_directory AND mft_reference % 11 = 0) AND NOT (is_directory AND mft_reference >= 1000 AND mft_reference % 37 = 0) AND instr(full_path, concat(':', chr(92), 'NATION_7')) = 0""",
    "watch_events": """SELECT ts, event_id AS seq, concat('user_', user_id) AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM {events}""",
    "raw_events": """SELECT ts, event_id AS seq, concat('/home/user_', user_id, CASE WHEN event_id % 9 = 0 THEN '/.cache' ELSE '' END) AS path,
      CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'access' ELSE 'modify' END AS raw_kind FROM {events}""",
    "path_mappings": """SELECT concat(chr(92), chr(92), lower(host), chr(92), lower(part)) AS unc, concat(chr(CAST(65 + min(page_id) % 26 AS INT)), ':') AS drive
      FROM (SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS part FROM {pages}) p WHERE page_id % 3 = 0 AND part <> '' GROUP BY lower(host), lower(part)
      UNION ALL SELECT concat(chr(92), chr(92), lower(host)), concat(chr(CAST(65 + (min(page_id) + 7) % 26 AS INT)), ':')
      FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM {pages}) p WHERE page_id % 3 = 0 GROUP BY lower(host)""",
    "manual_mappings": """SELECT concat(chr(92), chr(92), upper(split_part(url, '/', 3))) AS unc, concat(chr(CAST(65 + page_id % 26 AS INT)), CASE WHEN page_id % 8 = 0 THEN ':' ELSE '' END) AS drive, page_id AS seq
      FROM {pages} WHERE page_id % 4 = 0""",
}
#: The same rows for Spark: what is a parent at all is told first, and each parent's path from its own, so that the whole table
#: meets a table of parents once, by as many keys as there are parents, and not itself twice, the second time by those at the top.
_BESIDE = {
    "scan_entries": """WITH p AS (SELECT file_reference, parent_reference, name FROM {mft} WHERE file_reference IN (SELECT parent_reference FROM {mft} GROUP BY parent_reference)),
      up AS (SELECT p.file_reference, concat(CASE WHEN g.name IS NULL THEN '' ELSE concat(g.name, chr(92)) END, CASE WHEN p.name IS NULL THEN '' ELSE concat(p.name, chr(92)) END) AS path
        FROM p LEFT JOIN p g ON p.parent_reference = g.file_reference)
      SELECT f.file_reference AS mft_reference, f.volume_id, f.name, f.is_directory, f.size, f.created_time,
      concat(chr(CAST(66 + f.volume_id AS INT)), ':', chr(92), coalesce(up.path, ''), f.name) AS full_path FROM {mft} f LEFT JOIN up ON f.parent_reference = up.file_reference""",
}
_NEEDS = {"scan_entries": ("mft",), "files": ("mft", "scan_entries"), "listing": ("mft", "scan_entries", "files")}
#: Views that are written once for a session and a folder, as a catalog would be; the others are made from them.
_STORED = ("mft", "scan_entries", "files")
_written: dict[tuple, tuple[str, StructType]] = {}


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder: one listing, by Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def with_views(sql: str, *names: str) -> str:
    """A query with the views that it names before it."""
    wanted = {n for name in names for n in (*_NEEDS.get(name, ()), name)}
    itself = {n: n for n in (*TABLES, *VIEWS)}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].format(**itself)})" for n in VIEWS if n in wanted) + (" , " if sql.startswith(",") else " ") + sql.removeprefix(",")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables below a folder. Catalog tables are written once, by volume, and read from there until the tables
    below the folder are others."""
    text = _BESIDE.get(name, VIEWS[name])
    asked = set(re.findall(r"\{(\w+)\}", text))
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir) if name in _STORED else ())
    if key in _written:
        where, schema = _written[key]
        return spark.read.schema(schema).parquet(where)
    made = spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") if n in TABLES else derive(spark, sf_dir, n) for n in asked})
    if name not in _STORED:
        return made
    write_by_volume(made, where := shared_dir(spark, name))
    _written[key] = where, StructType([f for f in made.schema if f.name != "volume_id"] + [made.schema["volume_id"]])
    return derive(spark, sf_dir, name)


def read_catalog(raw: DataFrame) -> DataFrame:
    """Catalog rows with sizes below zero as zero and negative times and references as none (times are epoch seconds)."""
    names = raw.columns
    out = raw.withColumn("size", clamp_size(F.col("size")))
    for c in ("created_time", "modified_time"):
        if c in names and raw.schema[c].dataType.typeName() in ("long", "integer"):
            out = out.withColumn(c, known_time(F.col(c)))
    return out.withColumn("mft_reference", F.when(F.col("mft_reference") >= 0, F.col("mft_reference")))


def read_volumes(raw: DataFrame) -> DataFrame:
    return raw.withColumn("volume_type", volume_type_norm(F.col("volume_type"))).withColumn("label", F.when(F.col("label") != "", F.col("label")))


def volume_by_serial(volumes: DataFrame, serial: str) -> DataFrame:
    return volumes.where(F.col("serial_number") == serial)


def scan_for_check(files: DataFrame, volume_id: int | None = None, max_id: int | None = None, id_col: str = "mft_reference") -> DataFrame:
    """The three columns that a check reads, of one volume and up to an id where asked."""
    out = files.select(F.col(id_col).alias("id"), "volume_id", "full_path", "is_directory")
    if volume_id is not None:
        out = out.where(F.col("volume_id") == volume_id)
    return (out if max_id is None else out.where(F.col("id") <= max_id)).drop("volume_id")


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match("[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _excluded(path: str, patterns: tuple[str, ...]) -> bool:
    for p in patterns:
        inner = p.strip("*")
        if not inner:
            continue  # as in `search.excluded`: a pattern of stars alone excludes nothing
        if p.startswith("*") and not p.endswith("*"):
            found = path.endswith(inner)
        elif p.endswith("*") and not p.startswith("*"):
            found = path.startswith(inner)
        else:
            found = inner in path
        if found:
            return True
    return False


def _children(root: str, excludes: tuple[str, ...], hidden: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if (hidden or not f.base_name.startswith(".") or f.base_name.startswith(".tmp")) and not _excluded(f.path, excludes)]
                yield pa.record_batch([pa.array([f.path for f in found], pa.string()), pa.array([f.base_name for f in found], pa.string()), pa.array([f.type == pafs.FileType.Directory for f in found], pa.bool_()), pa.array([f.size or 0 for f in found], pa.int64()), pa.array([f.mtime for f in found], pa.timestamp("us", "UTC"))], names=["full_path", "name", "is_directory", "size", "modified"])

    return run


def read_listing(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """All below a folder that nodes share, and the folder itself (size 0): full_path, name, is_directory, size, modified, in
    order of full_path. Excluded and hidden folders are not entered; empty ones are listed. Each round lists the folders that
    the one before found, one task for many, so rounds are as many as the tree is deep."""
    fs, top = _file_system(root)
    if fs.get_file_info(top).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder to list: {root}")
    schema = "full_path string, name string, is_directory boolean, size long, modified timestamp"
    level = spark.createDataFrame([(top.rstrip("/"), top.rstrip("/").rpartition("/")[2], True, 0, None)], schema)
    found = level
    while not level.where("is_directory").isEmpty():
        level = cut(level.where("is_directory").select("full_path").repartition("full_path").mapInArrow(_children(root, excludes, hidden), schema))
        found = found.unionByName(level)
    return listing_order(found)


def listing_order(listing: DataFrame) -> DataFrame:
    """By path, dealt in ranges of it."""
    return listing.orderBy("full_path")


def listing_to_catalog(listing: DataFrame, volume_id: int) -> DataFrame:
    return listing.select(F.lit(None).cast("long").alias("mft_reference"), F.lit(volume_id).cast("long").alias("volume_id"), F.regexp_extract("full_path", r"([^\\/]+)[\\/]?$", 1).alias("name"), "is_directory", F.when(F.col("is_directory"), 0).otherwise(clamp_size(F.col("size"))).alias("size"), "full_path", parent_path(F.col("full_path")).alias("parent"))


def read_record_snapshot(records: DataFrame) -> DataFrame:
    """Records of real entries: references from 24 on with a name; directories have attribute bit 0x10."""
    return records.where((F.col("file_reference") >= 24) & (F.col("name") != "")).withColumn("is_directory", F.col("attributes").bitwiseAND(F.lit(0x10).cast("long")) != 0)


#: What notifications of each kind become; others go.
KINDS = {"create": "created", "modify": "modified", "remove": "deleted"}


def read_watch_events(raw: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Notifications (path, raw_kind, …) with their kind; other kinds go, and paths that contain an excluded text."""
    kind = F.coalesce(*(F.when(F.col("raw_kind") == k, v) for k, v in KINDS.items()))
    out = raw.withColumn("kind", kind).where("kind IS NOT NULL").drop("raw_kind")
    for text in excludes:
        out = out.where(~F.contains("path", F.lit(text)))
    return out


def load_path_mappings(detected: DataFrame, manual: DataFrame) -> DataFrame:
    """unc, drive: prefixes in lower case, drives with a colon. `manual` (with seq) goes over `detected`; of equal prefixes the
    last by seq counts."""
    drive = F.when(F.col("drive").endswith(":"), F.col("drive")).otherwise(F.concat("drive", F.lit(":")))
    pairs = detected.select("unc", "drive", F.lit(None).cast("long").alias("seq")).unionByName(manual.select("unc", "drive", F.col("seq").cast("long").alias("seq")))
    order = F.struct(F.col("seq").isNotNull(), F.col("seq"))
    return pairs.groupBy(F.lower("unc").alias("unc")).agg(F.max_by(drive, order).alias("drive"))
