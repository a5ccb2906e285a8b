"""Every catalog query by name, over the derived catalog, with the same query as SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import maintain as M
from ..operators import relocate as R
from ..operators import search as S
from ..operators import stats as T
from ..operators import tree as G
from ..session import shared_dir
from ..sources import catalog as C
from ..sources import journal as J
from ..sources.buckets import BucketedCatalog
from ..sources.records import decode_record_buffers
from ..sources.store import CatalogStore
from ..streaming import changes as H

Views = Callable[[str], DataFrame]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: SQL of the fold of A to Z, and of names' stems and paths' parents, for the oracle side.
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LN, LP = FOLD.format("name"), FOLD.format("full_path")
STEM = "CASE WHEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) = '' THEN name ELSE regexp_extract(name, '^(.+)\\.[^.]*$', 1) END"
EXT = "CASE WHEN NOT is_directory AND regexp_extract(name, '^.+\\.([^.]*)$', 1) <> '' THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) END"
_UP = "regexp_extract(full_path, '^(.*)[\\\\/][^\\\\/]+[\\\\/]?$', 1)"
PARENT = f"CASE WHEN regexp_matches({_UP}, '^[A-Za-z]:$') THEN concat({_UP}, chr(92)) WHEN {_UP} <> '' THEN {_UP} END"
SIZE = " ".join(f"WHEN size >= {1024**p} THEN concat(printf('%.2f', round_even(size / {float(1024**p)}, 2)), ' {u}')" for p, u in ((3, "GB"), (2, "MB"), (1, "KB")))
STATS = "count(CASE WHEN NOT is_directory THEN 1 END) AS total_files, count(CASE WHEN is_directory THEN 1 END) AS total_directories, CAST(coalesce(sum(CASE WHEN NOT is_directory THEN size END), 0) AS BIGINT) AS total_size"
ROW = "full_path, size"


def query(name: str, needs: str, run: Callable[[Views], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: run(lambda v: C.derive(spark, sf_dir, v))
    if sql:
        _SQL[name] = C.with_views(sql, *needs.split())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _found(*patterns: str, **how) -> Callable[[Views], DataFrame]:
    return lambda v: S.search(v("files"), list(patterns), **how).select("full_path", "size")


def _where(test: str) -> str:
    return f"SELECT {ROW} FROM files WHERE {test}"


def _files(run: Callable[[DataFrame], DataFrame], *columns: str) -> Callable[[Views], DataFrame]:
    return lambda v: run(v("files")).select(*(columns or ("full_path", "size")))


# Searches
query("search_glob", "files", _found("*.tar.gz", sort="name"), _where(f"{LN} LIKE '%.tar.gz'"))
query("search_name", "files", _found("ring", kind="plain", sort="name"), _where(f"{LN} LIKE '%ring%'"))
query("search_names_all", "files", _found("red", "ring", kind="plain", mode="all"), _where(f"{LN} LIKE '%red%' AND {LN} LIKE '%ring%'"))
query("search_exact_name", "files", lambda v: S.search(_store(v).read(folded=True), ["RED RING_5.TXT"], kind="exact", sort="full_path").select("full_path", "size"), _where(f"{LN} = 'red ring_5.txt'"))
query("search_globs_all", "files", _found("*report*", "*_1?.*", mode="all"), _where(f"{LN} LIKE '%report%' AND {LN} LIKE '%^_1_.%' ESCAPE '^'"))
query("search_regex", "files", _found("^an.*rod_[0-9]+\\.pdf$", kind="regex"), _where("regexp_matches(name, '^an.*rod_[0-9]+\\.pdf$', 'i')"))
query("search_regexes_all", "files", _found("^old", "log_[0-3]", kind="regex", mode="all"), _where("regexp_matches(name, '^old', 'i') AND regexp_matches(name, 'log_[0-3]', 'i')"))
query("search_regex_classes", "files", _found(r"^(?P<first>[[:alpha:]]+)[ .]\pL+_\d{1,2}(?:\.[\p{L}--[p]]+)?$", kind="regex"), _where("regexp_matches(name, '^(?P<first>[[:alpha:]]+)[ .]\\pL+_[0-9]{1,2}(?:\\.[a-oq-z]+)?$', 'i')"))
query("search_path", "files", _found("NATION_1\\customer#00", kind="path", sort="full_path"), _where(f"{LP} LIKE concat('%nation_1', chr(92), 'customer#00%')"))
query("search_any", "files", _found("*.mp4", "plate", "red?ring*"), _where(f"{LN} LIKE '%.mp4' OR {LN} LIKE '%plate%' OR {LN} LIKE 'red_ring%'"))
query("search_all", "files", _found("*.txt", "*old*", mode="all"), _where(f"{LN} LIKE '%.txt' AND {LN} LIKE '%old%'"))
query("search_all_mixed", "files", _found("*.pdf", "annual", mode="all"), _where(f"{LN} LIKE '%.pdf' AND {LN} LIKE '%annual%'"))
query("expand_patterns", "files", _found("red ring", "old.log", expand=True), _where(" OR ".join(f"{LN} LIKE '%{p}%'" for p in ("red ring", "red.ring", "redring", "old.log", "old log", "oldlog"))))
query("expand_mixed_pattern", "files", _found("red.ring_1 x", "red ring_1", expand=True), _where(" OR ".join(f"contains({LN}, '{p}')" for p in ("red.ring_1 x", "red ring_1 x", "redring_1 x"))) + " OR " + " OR ".join(f"{LN} LIKE '%{p}%'" for p in ("red ring_1", "red.ring_1", "redring_1")))
query("multi_query_search", "files", lambda v: S.multi_query_search(v("files"), v("volumes").select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.lit, ("ring", "LOG_1", "plate", "annual", "rod_2"))), F.col("id").cast("int")).alias("pattern"))).select("query_id", "full_path"), f"SELECT query_id, full_path FROM files JOIN (VALUES (1, 'ring'), (2, 'log_1'), (3, 'plate'), (4, 'annual'), (5, 'rod_2')) q(query_id, pattern) ON contains({LN}, pattern)")
#: Saved searches of every kind, one for each volume, and their SQL.
SAVED = (("ring", "plain"), ("*log?1*", "auto"), (r"(?P<kind>plate|plank)\S*[[:digit:]]{2}$", "regex"), ("nation_1", "exact"), (r"^\p{L}+.?[0-9]*[02468]\.", "regex"))
SAVED_SQL = ((1, f"contains({LN}, 'ring')"), (2, f"regexp_matches({LN}, '^.*log.1.*$', 's')"), (3, "regexp_matches(name, '(?i)(plate|plank)[^ ]*[0-9][0-9]$')"), (4, f"{LN} = 'nation_1'"), (5, r"regexp_matches(name, '^[A-Za-z]+.?[0-9]*[02468]\.')"))


def _saved(v: Views) -> DataFrame:
    nth = F.element_at(F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(k).alias("kind")) for p, k in SAVED)), F.col("id").cast("int"))
    return v("volumes").where(F.col("id") <= len(SAVED)).select(F.col("id").alias("query_id"), nth["pattern"].alias("pattern"), nth["kind"].alias("kind"))


query("multi_query_search_kinds", "files volumes", lambda v: S.multi_query_search(v("files"), _saved(v)).select("query_id", "full_path"), " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS query_id, full_path FROM files WHERE {test} AND EXISTS (SELECT 1 FROM volumes WHERE id = {n})" for n, test in SAVED_SQL))
query("filter_drives", "files", _files(lambda f: S.filter_drives(f, ("d:", "F"))), _where("upper(substr(full_path, 1, 1)) IN ('D', 'F')"))
query("filter_type", "files", _files(lambda f: S.filter_type(f, "dirs")), _where("is_directory"))
query("filter_path_prefix", "files", _files(lambda f: S.filter_path_prefix(f, ["C:\\Nation_1", "e:\\"])), _where("starts_with(lower(full_path), concat('c:', chr(92), 'nation_1')) OR starts_with(lower(full_path), concat('e:', chr(92)))"))
query("filter_ignored", "files", _files(S.filter_ignored), _where("NOT contains(full_path, '$Recycle') AND NOT contains(full_path, '#Recycle')"))
query("filter_excludes", "files", _files(lambda f: S.filter_excludes(f, ["*.mp4", "*NATION_2*", "C:\\NATION_1*"], P.ancestor_paths(F.col("full_path")))), _where("NOT (ends_with(full_path, '.mp4') OR contains(full_path, 'NATION_2') OR starts_with(full_path, concat('C:', chr(92), 'NATION_1')))"))
query("filter_hidden", "files", _files(lambda f: S.filter_hidden(f, P.ancestor_paths(F.col("full_path")))), _where("NOT (starts_with(name, '.') AND NOT starts_with(name, '.tmp'))"))
query("filter_event_excludes", "watch_events", lambda v: S.filter_event_excludes(v("watch_events"), ["_1", "99"]).select("seq", "path"), "SELECT seq, path FROM watch_events WHERE NOT contains(path, '_1') AND NOT contains(path, '99')")
query("filter_reason", "changes", lambda v: v("changes").where(P.has_flag(F.col("reason"), P.CLOSE | P.DELETE)).select("usn", "reason"), "SELECT usn, reason FROM changes WHERE reason & 2147484160 <> 0")
query(
    "needs_full_scan",
    "files",
    lambda v: M.needs_full_scan(v("files")).withColumn("asked", F.lit("catalog")).unionByName(M.needs_full_scan(v("files"), forced=True).withColumn("asked", F.lit("forced"))).unionByName(M.needs_full_scan(v("files").where("volume_id > 5")).withColumn("asked", F.lit("none"))),
    "SELECT 'catalog' AS asked, count(*) = 0 AS needed FROM files UNION ALL SELECT 'forced', TRUE UNION ALL SELECT 'none', count(*) = 0 FROM files WHERE volume_id > 5",
)
query("union_dedupe", "files", lambda v: S.union_dedupe(*(S.search(v("files"), [p]) for p in ("ring", "red"))).select("full_path", "size"), _where(f"{LN} LIKE '%ring%' OR {LN} LIKE '%red%'"))
query("intersect_on_path", "files", lambda v: S.intersect_on_path(*(S.search(v("files"), [p]) for p in ("ring", "red"))).select("full_path", "size"), _where(f"{LN} LIKE '%ring%' AND {LN} LIKE '%red%'"))
query("sort_results", "files", _found("report", sort="size"), _where(f"{LN} LIKE '%report%'"))
query("top_k_search", "files", _found("log", sort="name", limit=50), _where(f"{LN} LIKE '%log%'") + " ORDER BY name, full_path LIMIT 50")

# Columns
_columns = {
    "file_stem": (lambda: P.file_stem(F.col("name")), STEM),
    "extension": (lambda: P.extension(F.col("name"), F.col("is_directory")), EXT),
    "parent_path": (lambda: P.parent_path(F.col("full_path")), PARENT),
    "drive_letter": (lambda: P.drive_letter(F.col("full_path")), "upper(substr(full_path, 1, 1))"),
    "volume_prefix": (lambda: P.volume_prefix(F.col("full_path")), "lower(substr(full_path, 1, 2))"),
    "volume_key": (lambda: P.volume_key(F.col("full_path")), "upper(substr(full_path, 1, 2))"),
    "normalize_extended": (lambda: P.normalize_extended(F.concat(F.lit("\\\\?\\"), "full_path")), "lower(full_path)"),
    "format_size": (lambda: P.format_size(F.col("size")), f"CASE {SIZE} ELSE concat(size, ' B') END"),
    "format_count": (lambda: P.format_count(F.col("size")), "format('{:,}', size)"),
    "highlight_name": (lambda: P.highlight_name(F.col("name"), ["ring", "red"]), "regexp_replace(name, '((?:red|ring)+)', '[\\1]', 'gi')"),
    "file_uri": (lambda: P.file_uri(F.col("full_path")), "concat('file:///', replace(replace(replace(full_path, chr(92), '/'), ' ', '%20'), '#', '%23'))"),
    "clamp_size": (lambda: P.clamp_size(F.col("size") - 1000), "greatest(size - 1000, 0)"),
    "regexp_function": (lambda: F.rlike("name", F.lit("(?U)[0-9]{2}")), "regexp_matches(name, '[0-9]{2}')"),
}
for _name, (_column, _sql) in _columns.items():
    query(_name, "files", _files(lambda f, c=_column: f.withColumn("value", c()), "full_path", "value"), f"SELECT full_path, {_sql} AS value FROM files")
query("ancestor_paths", "files", _files(lambda f: f.select("full_path", F.explode(P.ancestor_paths(F.col("full_path"))).alias("ancestor")), "full_path", "ancestor"), "SELECT full_path, array_to_string(list_slice(string_split(full_path, chr(92)), 1, i), chr(92)) AS ancestor FROM files, generate_series(2, 9) t(i) WHERE i < len(string_split(full_path, chr(92)))")
query(
    "classify_path",
    "files unc_paths volumes",
    lambda v: R.classify_paths(v("files").select("full_path").unionByName(v("unc_paths").select("full_path")).distinct(), v("volumes")),
    "SELECT DISTINCT full_path, CASE WHEN starts_with(full_path, concat(chr(92), chr(92))) THEN 'unc' WHEN EXISTS (SELECT 1 FROM volumes v WHERE volume_type = 'network' AND starts_with(full_path, v.mount_point)) THEN 'mapped_network' ELSE 'local' END AS path_class FROM (SELECT full_path FROM files UNION ALL SELECT full_path FROM unc_paths)",
)
query("volume_type", "volumes", lambda v: v("volumes").select("id", P.volume_type_norm(F.upper("volume_type")).alias("kind"), P.volume_type_label(F.col("volume_type")).alias("shown"), P.mount_label(F.col("mount_point"), F.col("label")).alias("mount")), "SELECT id, volume_type AS kind, CASE volume_type WHEN 'ntfs' THEN 'NTFS' ELSE concat(upper(substr(volume_type, 1, 1)), substr(volume_type, 2)) END AS shown, concat_ws(' ', mount_point, label) AS mount FROM volumes")
query("epoch_seconds", "files", _files(lambda f: f.select("full_path", F.unix_timestamp(F.col("created_time").cast("timestamp")).alias("seconds"), P.known_time(F.unix_timestamp(F.col("created_time").cast("timestamp")) - 800000000).cast("timestamp_ntz").alias("shifted")), "full_path", "seconds", "shifted"), "SELECT full_path, CAST(epoch(created_time) AS BIGINT) AS seconds, CASE WHEN epoch(created_time) >= 800000000 THEN make_timestamp(CAST((epoch(created_time) - 800000000) * 1000000 AS BIGINT)) END AS shifted FROM files")
query("event_kind", "changes", lambda v: v("changes").select("usn", P.event_kind(F.col("reason")).alias("kind")), "SELECT usn, CASE WHEN reason & 256 <> 0 THEN 'created' WHEN reason & 512 <> 0 THEN 'deleted' WHEN reason & 8192 <> 0 THEN 'created' WHEN reason & 7 <> 0 THEN 'modified' END AS kind FROM changes")

# Sources
query("read_catalog", "files", lambda v: C.read_catalog(v("files").withColumn("size", F.col("size") - 50000)).select("full_path", "size", "mft_reference"), "SELECT full_path, greatest(size - 50000, 0) AS size, mft_reference FROM files")
query("read_volumes", "volumes", lambda v: C.read_volumes(v("volumes")).select("id", "label", "volume_type"), "SELECT id, label, volume_type FROM volumes")
query("volume_by_serial", "volumes", lambda v: C.volume_by_serial(v("volumes"), "SER2").select("id", "serial_number"), "SELECT id, serial_number FROM volumes WHERE serial_number = 'SER2'")
query("scan_for_check", "files", lambda v: C.scan_for_check(v("files"), 2, 1000030000), "SELECT mft_reference AS id, full_path, is_directory FROM files WHERE volume_id = 2 AND mft_reference <= 1000030000")
query("listing_to_catalog", "listing", lambda v: C.listing_to_catalog(v("listing"), 7).select("volume_id", "name", "size", "full_path"), "SELECT CAST(7 AS BIGINT) AS volume_id, regexp_extract(full_path, '([^\\\\/]+)$', 1) AS name, size, full_path FROM listing")
query("read_record_snapshot", "mft", lambda v: C.read_record_snapshot(v("mft").withColumn("attributes", F.when(F.col("is_directory"), 16).otherwise(32).cast("long"))).select("file_reference", "is_directory"), "SELECT file_reference, is_directory FROM mft WHERE file_reference >= 24 AND name <> ''")
_after = lambda v, times: v("volumes").where("id <> 4").select(F.col("id").alias("volume_id"), (F.col("last_usn") * times).alias("last_usn"))
AFTER = "(SELECT id AS volume_id, last_usn * {} AS last_usn FROM volumes WHERE id <> 4)"
query("read_change_log", "changes volumes", lambda v: J.read_change_log(v("changes"), _after(v, 100))[0].select("volume_id", "usn", "name"), f"SELECT c.volume_id, usn, name FROM changes c LEFT JOIN {AFTER.format(100)} o ON o.volume_id = c.volume_id WHERE last_usn IS NULL OR usn > last_usn")
query("change_log_offsets", "changes volumes", lambda v: J.read_change_log(v("changes"), _after(v, 200))[1], f"SELECT v.id AS volume_id, greatest(m.usn, o.last_usn) AS last_usn FROM volumes v LEFT JOIN {AFTER.format(200)} o ON o.volume_id = v.id LEFT JOIN (SELECT volume_id, max(usn) AS usn FROM changes GROUP BY 1) m ON m.volume_id = v.id")
query("read_watch_events", "raw_events", lambda v: C.read_watch_events(v("raw_events"), ("/.cache",)).select("seq", "path", "kind"), "SELECT seq, path, CASE raw_kind WHEN 'create' THEN 'created' WHEN 'remove' THEN 'deleted' ELSE 'modified' END AS kind FROM raw_events WHERE raw_kind <> 'access' AND NOT contains(path, '/.cache')")
query(
    "load_path_mappings",
    "path_mappings manual_mappings",
    lambda v: C.load_path_mappings(v("path_mappings").select(F.upper("unc").alias("unc"), F.substring("drive", 1, 1).alias("drive")), v("manual_mappings")),
    ", m AS (SELECT lower(unc) AS unc, max_by(concat(substr(drive, 1, 1), ':'), seq) AS drive FROM manual_mappings GROUP BY 1) SELECT unc, drive FROM m UNION ALL SELECT unc, drive FROM path_mappings WHERE unc NOT IN (SELECT unc FROM m)",
)
query("report_list", "files", _files(T.report, "is_directory", "shown"), "SELECT is_directory, full_path AS shown FROM files")
query("report_name", "files", _files(lambda f: T.report(f, True), "is_directory", "shown"), "SELECT is_directory, name AS shown FROM files")
query("listing_order", "listing", lambda v: C.listing_order(v("listing")), "SELECT full_path, is_directory, size FROM listing ORDER BY full_path")


def _listed(v: Views) -> DataFrame:
    """Lists what a catalog written by volume has become: its folder and one for each volume; the files' names are Spark's own."""
    files = v("files")
    where = shared_dir(files.sparkSession, "tree")
    files.select("volume_id", "full_path").write.partitionBy("volume_id").parquet(where)
    found = C.read_listing(files.sparkSession, where, ("*=3",))
    rows = files.sparkSession.read.option("recursiveFileLookup", True).parquet(where).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.where("is_directory").select(F.when(F.col("full_path") == where, "root").otherwise(F.col("name")).alias("name"), "is_directory", "size", F.lit(rows.first()[0]).alias("n_rows"))


query("read_listing", "files", _listed, "SELECT name, TRUE AS is_directory, CAST(0 AS BIGINT) AS size, (SELECT count(*) FROM files) AS n_rows FROM (SELECT DISTINCT concat('volume_id=', volume_id) AS name FROM files WHERE volume_id <> 3 UNION ALL SELECT 'root')")


def _little(value, width: int):
    """Bytes of a number in hex, lowest first."""
    digits = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * width, F.lit(2 * width))
    return F.array_join(F.transform(F.sequence(F.lit(width), F.lit(1), F.lit(-1)), lambda i: F.substring(digits, 2 * i - 1, F.lit(2))), "")


def _buffers(v: Views) -> DataFrame:
    """Change records in buffers of fifty at most, odd ones in the layout of version 3; references carry a sequence above 48 bits."""
    name = F.hex(F.encode("name", "UTF-16LE"))
    n, wide = F.length(name) / 2, F.col("usn") / 64 % 2 == 1
    size = F.when(wide, 76).otherwise(60) + n
    padded = F.ceil(size / 8) * 8
    reference = lambda c: F.concat(_little(F.col(c) + (7 << 48), 8), F.when(wide, "0" * 16).otherwise(""))
    record = F.concat(
        _little(padded, 4), _little(F.when(wide, 3).otherwise(2), 2), F.lit("0000"), reference("file_reference"), reference("parent_reference"), _little(F.col("usn"), 8), F.lit("0" * 16), _little(F.col("reason"), 4),
        F.lit("0" * 16), _little(F.when(F.col("is_directory"), 0x10).otherwise(0x20), 4), _little(n, 2), _little(F.when(wide, 76).otherwise(60), 2), name, F.repeat(F.lit("00"), (padded - size).cast("int")),
    )
    rows = v("changes").select(F.floor(F.col("usn") / 3200).alias("g"), "usn", record.alias("r"))
    return rows.groupBy("g").agg(F.unhex(F.concat(_little(F.max("usn") + 64, 8), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("usn", "r"))), lambda x: x["r"]), ""), F.lit("00000000"))).alias("buffer"))


query("decode_record_buffers", "changes", lambda v: decode_record_buffers(_buffers(v)), "SELECT max(usn) OVER (PARTITION BY usn // 3200) + 64 AS next, usn, file_reference, parent_reference, name, reason, CAST(32 AS BIGINT) AS attributes, is_directory FROM changes")

# Aggregates
ANC = "SELECT full_path, array_to_string(list_slice(string_split(full_path, chr(92)), 1, i), chr(92)) AS directory FROM files, generate_series(2, 9) t(i) WHERE NOT is_directory AND i < len(string_split(full_path, chr(92)))"
DUPS = f"stems AS (SELECT *, lower({STEM}) AS stem FROM files WHERE NOT is_directory), d AS (SELECT *, count(*) OVER (PARTITION BY stem) AS n FROM stems)"
query("catalog_stats", "files volumes", lambda v: T.catalog_stats(v("files"), v("volumes")), f"SELECT {STATS}, (SELECT count(*) FROM volumes) AS total_volumes FROM files")
query("volume_stats", "files", lambda v: T.volume_stats(v("files")), f"SELECT volume_id, {STATS} FROM files GROUP BY volume_id")
query("volumes_with_stats", "files volumes", lambda v: T.sort_volumes(T.volumes_with_stats(v("files"), v("volumes")), "size"), f"SELECT v.id AS volume_id, mount_point, label, volume_type, is_online, {STATS} FROM volumes v LEFT JOIN files f ON f.volume_id = v.id GROUP BY ALL")
query("sort_volumes", "files volumes", lambda v: T.sort_volumes(T.volumes_with_stats(v("files"), v("volumes")), "label").select("volume_id", "label", "total_files"), "SELECT v.id AS volume_id, label, count(CASE WHEN NOT is_directory THEN 1 END) AS total_files FROM volumes v LEFT JOIN files f ON f.volume_id = v.id GROUP BY ALL")
query("max_file_id", "files", _files(T.max_file_id, "max_id"), "SELECT coalesce(max(mft_reference), 0) AS max_id FROM files")
query("result_counts", "files", lambda v: T.result_counts(S.search(v("files"), ["red"])), f"SELECT count(CASE WHEN is_directory THEN 1 END) AS directories, count(CASE WHEN NOT is_directory THEN 1 END) AS files FROM files WHERE {LN} LIKE '%red%'")
query("duplicate_stems", "files", _files(T.duplicate_stems, "stem", "n"), f"SELECT lower({STEM}) AS stem, count(*) AS n FROM files WHERE NOT is_directory GROUP BY 1 HAVING count(*) >= 2")
query("duplicate_groups", "files", _files(T.duplicate_groups, "stem", "full_path"), f", {DUPS} SELECT stem, full_path FROM d WHERE n >= 2")
query("duplicates_by_drive", "files", _files(lambda f: T.duplicates_by_drive(f, ("C", "D")), "stem", "full_path"), f", {DUPS}, h AS (SELECT stem, full_path, count(*) OVER (PARTITION BY stem) AS here FROM d WHERE n >= 2 AND substr(full_path, 1, 1) IN ('C', 'D')) SELECT stem, full_path FROM h WHERE here >= 2")
query("limit_duplicate_groups", "files", _files(lambda f: T.limit_duplicate_groups(T.duplicate_groups(f), 10), "stem", "full_path"), f", {DUPS} SELECT stem, full_path FROM (SELECT *, dense_rank() OVER (ORDER BY stem) AS k FROM d WHERE n >= 2) WHERE k <= 10")
query("duplicates_summary", "files", _files(lambda f: T.duplicates_summary(T.duplicate_groups(f), 100), "n_groups", "n_files", "not_shown"), f", {DUPS} SELECT count(DISTINCT stem) AS n_groups, count(*) AS n_files, greatest(count(DISTINCT stem) - 100, 0) AS not_shown FROM d WHERE n >= 2")
query("directory_sizes", "files", _files(T.directory_sizes, "directory", "size"), f"SELECT {PARENT} AS directory, CAST(sum(size) AS BIGINT) AS size FROM files WHERE NOT is_directory GROUP BY 1")
query("sort_directories_by_size", "files", _files(lambda f: T.directory_sizes(f).orderBy(F.desc("size"), "directory"), "directory", "size"), f"SELECT {PARENT} AS directory, CAST(sum(size) AS BIGINT) AS size FROM files WHERE NOT is_directory GROUP BY 1 ORDER BY 2 DESC, 1")
query("directory_counts", "files", lambda v: T.directory_counts(v("files"), v("files").where("is_directory")), f", a AS ({ANC}) SELECT d.full_path AS directory, count(a.full_path) AS n_files FROM files d LEFT JOIN a ON a.directory = d.full_path WHERE d.is_directory GROUP BY 1")
query("files_under_directories", "files", lambda v: T.files_under_directories(v("files"), v("files").where("is_directory AND name LIKE 'NATION%'")), f", a AS ({ANC}) SELECT directory, a.full_path FROM a JOIN files d ON a.directory = d.full_path AND d.name LIKE 'NATION%'")
INFO = f"a AS ({ANC}), s AS (SELECT {PARENT} AS directory, CAST(sum(size) AS BIGINT) AS size FROM files WHERE NOT is_directory GROUP BY 1), c AS (SELECT directory, count(*) AS n FROM a GROUP BY 1)"
query("info_directories", "files", _files(T.info_directories, "directory", "n_files", "size"), f", {INFO} SELECT d.full_path AS directory, coalesce(c.n, 0) AS n_files, s.size FROM files d LEFT JOIN c ON c.directory = d.full_path LEFT JOIN s ON s.directory = d.full_path WHERE d.is_directory")
query("report_info", "files", _files(T.report_info, "is_directory", "full_path", "size", "n_files"), f", {INFO} SELECT is_directory, d.full_path, s.size, coalesce(c.n, 0) AS n_files FROM files d LEFT JOIN c ON c.directory = d.full_path LEFT JOIN s ON s.directory = d.full_path WHERE d.is_directory UNION ALL SELECT is_directory, full_path, size, NULL FROM files WHERE NOT is_directory")
query("scan_summary", "files", _files(T.scan_summary, "volume_id", "n"), "SELECT volume_id, count(*) AS n FROM files GROUP BY ROLLUP (volume_id)")
GROUPED = f"SELECT directory, full_path, rn, more FROM (SELECT {PARENT} AS directory, full_path, CAST(row_number() OVER (PARTITION BY {PARENT} ORDER BY full_path) AS INTEGER) AS rn, greatest(count(*) OVER (PARTITION BY {PARENT}) - 5, 0) AS more FROM files WHERE NOT is_directory) WHERE rn <= 5"
query("grouped_top_n", "files", _files(lambda f: T.grouped_top_n(f, 5), "directory", "full_path", "rn", "more"), GROUPED)
query(
    "report_grouped",
    "files listing",
    lambda v: T.report_grouped(S.search(v("files"), ["ring", "nation_1"]), v("listing"), 5),
    f""", r AS (SELECT * FROM files WHERE contains({LN}, 'ring') OR regexp_matches({LN}, 'nation.1')),
    g AS ({GROUPED.replace("FROM files WHERE", "FROM r WHERE")}),
    held AS (SELECT DISTINCT {PARENT} AS directory FROM listing WHERE NOT is_directory),
    d AS (SELECT full_path AS directory, (SELECT count(*) FROM r f WHERE NOT f.is_directory AND starts_with(f.full_path, concat(r.full_path, chr(92)))) AS n_below FROM r WHERE is_directory),
    s AS (SELECT d.*, CASE WHEN directory NOT IN (SELECT full_path FROM listing WHERE is_directory) THEN 'missing' WHEN directory IN (SELECT directory FROM g) THEN 'files' WHEN directory IN (SELECT directory FROM held) THEN 'no_match' ELSE 'empty' END AS state FROM d)
    SELECT TRUE AS matched, s.directory, state, n_below, g.full_path, g.rn, g.more FROM s LEFT JOIN g ON g.directory = s.directory AND state <> 'missing'
    UNION ALL SELECT FALSE, directory, 'files', NULL, full_path, rn, more FROM g WHERE directory NOT IN (SELECT directory FROM d)""",
)
query("match_directories", "files", lambda v: T.match_directories(v("files").where("NOT is_directory OR mft_reference % 2 = 0"), False), f"SELECT DISTINCT {PARENT} AS directory FROM files WHERE NOT is_directory AND {PARENT} NOT IN (SELECT full_path FROM files WHERE is_directory AND mft_reference % 2 = 0)")
query("directory_state", "files listing", lambda v: T.directory_state(v("files").where("is_directory"), v("listing")), f", n AS (SELECT {PARENT} AS directory, count(*) AS n FROM listing WHERE NOT is_directory GROUP BY 1) SELECT f.full_path AS directory, CASE WHEN l.full_path IS NULL THEN 'missing' WHEN n.n IS NULL THEN 'empty' ELSE 'has_files' END AS state FROM files f LEFT JOIN listing l ON l.full_path = f.full_path AND l.is_directory LEFT JOIN n ON n.directory = f.full_path WHERE f.is_directory")

# Trees and set operations
query("resolve_paths", "scan_entries", lambda v: G.resolve_paths(v("mft"), v("volumes")), "SELECT mft_reference, volume_id, full_path FROM scan_entries")
query("subtree", "files", _files(lambda f: f.where(G.in_subtree(f, "C:/NATION_0"))), _where("full_path = concat('C:', chr(92), 'NATION_0') OR starts_with(full_path, concat('C:', chr(92), 'NATION_0', chr(92)))"))
query("under_missing", "files listing", lambda v: G.under_missing(v("files"), M.missing_entries(v("files").where("is_directory"), v("listing"))).select("full_path"), ", m AS (SELECT full_path FROM files WHERE is_directory AND full_path NOT IN (SELECT full_path FROM listing)) SELECT f.full_path FROM files f WHERE EXISTS (SELECT 1 FROM m WHERE starts_with(f.full_path, concat(m.full_path, chr(92))))")
query("missing_entries", "files listing", lambda v: M.missing_entries(v("files"), v("listing")).select("full_path", "is_directory"), "SELECT full_path, is_directory FROM files WHERE full_path NOT IN (SELECT full_path FROM listing)")
query("scan_root_dedupe", "files", lambda v: G.scan_root_dedupe(v("files").where("is_directory").select(F.when(F.col("volume_id") == 1, F.substring("full_path", 1, 3)).otherwise(F.col("full_path")).alias("path"))), "SELECT DISTINCT CASE WHEN volume_id = 1 THEN substr(full_path, 1, 3) ELSE full_path END AS path, upper(substr(full_path, 1, 2)) AS drive FROM files WHERE is_directory")

# Maintenance
KEPT, REMOVED = "full_path IN (SELECT full_path FROM listing) AND NOT below", "NOT (full_path IN (SELECT full_path FROM listing) AND NOT below)"
BELOW = "m AS (SELECT full_path FROM files WHERE is_directory AND full_path NOT IN (SELECT full_path FROM listing)), b AS (SELECT *, EXISTS (SELECT 1 FROM m WHERE starts_with(f.full_path, concat(m.full_path, chr(92)))) AS below FROM files f)"
_delta = lambda v: v("files").where("mft_reference % 5 = 0").withColumn("size", F.col("size") + 1)
_extra = lambda v: _delta(v).unionByName(_delta(v).withColumn("full_path", F.concat("full_path", F.lit(".new"))))
DELTA = "SELECT mft_reference, full_path, size + 1 AS size FROM files WHERE mft_reference % 5 = 0 UNION ALL SELECT mft_reference, concat(full_path, '.new'), size + 1 FROM files WHERE mft_reference % 5 = 0"
UPSERT = f", d AS ({DELTA}) SELECT full_path, size FROM d UNION ALL SELECT full_path, size FROM files WHERE full_path NOT IN (SELECT full_path FROM d)"
query("latest_per_path", "files", lambda v: M.latest_per_path(v("scan_entries"), "mft_reference").select("full_path", "mft_reference", "size"), "SELECT full_path, mft_reference, size FROM files")
query("upsert_files", "files", lambda v: M.upsert(v("files"), _extra(v), "full_path", ("mft_reference",), M.is_small(_extra(v))).select("full_path", "size"), UPSERT)
def _store(v: Views) -> CatalogStore:
    """The catalog as version 1 of a store."""
    files = v("files")
    store = CatalogStore(files.sparkSession, shared_dir(files.sparkSession, "store"), files.schema)
    store.replace(files)
    return store


def _merged(v: Views) -> DataFrame:
    """What readers find once new and changed rows of every volume are published."""
    store = _store(v)
    base = store.head()
    new = M.upsert(store.read(base), _extra(v).withColumn("mft_reference", F.lit(None).cast("long")), "full_path", ("mft_reference",))
    store.commit(base, M.assign_ids(new, "mft_reference", T.max_file_id(v("files")).first()[0]), base.folders)
    return store.read().select("full_path", "size", "volume_id")


query("write_catalog", "files", _merged, f", d AS (SELECT full_path, size + 1 AS size, volume_id FROM files WHERE mft_reference % 5 = 0 UNION ALL SELECT concat(full_path, '.new'), size + 1, volume_id FROM files WHERE mft_reference % 5 = 0) SELECT * FROM d UNION ALL SELECT full_path, size, volume_id FROM files WHERE full_path NOT IN (SELECT full_path FROM d)")
query("assign_ids", "files", lambda v: M.assign_ids(M.upsert(v("files"), _extra(v).withColumn("mft_reference", F.lit(None).cast("long")), "full_path", ("mft_reference",)), "mft_reference", 2_000_000_000).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mft_reference").alias("ids"), F.max("mft_reference").alias("largest")), "SELECT (SELECT count(*) FROM files) + count(*) AS n, (SELECT count(*) FROM files) + count(*) AS ids, 2000000000 + count(*) AS largest FROM files WHERE mft_reference % 5 = 0")
query("upsert_volume", "volumes", lambda v: M.upsert(v("volumes"), v("volumes").where("id > 3").withColumn("label", F.lit("new")), "serial_number", ("id",)).select("id", "serial_number", "label"), "SELECT id, serial_number, CASE WHEN id > 3 THEN 'new' ELSE label END AS label FROM volumes")
def _reset(v: Views) -> DataFrame:
    """Rows that readers find before and after a reset."""
    store = _store(v)
    count = lambda n: store.read(store.version(n)).agg(F.lit(n).cast("long").alias("version"), F.count(F.lit(1)).alias("n"))
    store.replace(v("files").limit(0))
    return count(1).unionByName(count(2))


query("reset_catalog", "files", _reset, "SELECT CAST(1 AS BIGINT) AS version, count(*) AS n FROM files UNION ALL SELECT 2, 0")
query("delete_path", "files", _files(lambda f: M.delete_path(f, "C:\\NATION_0")), _where("full_path <> concat('C:', chr(92), 'NATION_0')"))
def _without(v: Views, volume_id: int) -> DataFrame:
    store = _store(v)
    store.delete_volume(volume_id)
    return store.read().select("full_path", "size")


query("delete_volume_rows", "files", lambda v: _without(v, 3), _where("volume_id <> 3"))
query("delete_subtree", "files", _files(lambda f: M.delete_subtree(f, "C:/NATION_0")), _where("NOT (full_path = concat('C:', chr(92), 'NATION_0') OR starts_with(full_path, concat('C:', chr(92), 'NATION_0', chr(92))))"))
query("delete_references", "files", lambda v: M.delete_keys(v("files"), v("files").where("size % 3 = 0"), "volume_id", "mft_reference").select("full_path", "size"), _where("size % 3 <> 0"))
PURGED = _where(f"NOT EXISTS (SELECT 1 FROM changes c LEFT JOIN {AFTER.format(1)} o ON o.volume_id = c.volume_id WHERE c.volume_id = files.volume_id AND file_reference = mft_reference AND (last_usn IS NULL OR usn > last_usn) AND reason & 4608 <> 0)")
query("purge_references", "files changes volumes", lambda v: M.delete_keys(v("files"), H.stale_references(v("changes"), _after(v, 1)).select("volume_id", F.col("file_reference").alias("mft_reference")), "volume_id", "mft_reference").select("full_path", "size"), PURGED)
query("delete_ids", "files", lambda v: M.delete_keys(v("files"), v("files").where("mft_reference % 7 = 0"), "mft_reference").select("full_path", "size"), _where("mft_reference % 7 <> 0"))
query("relocate_path", "files", lambda v: M.relocate_path(v("files"), v("files").where("NOT is_directory AND mft_reference % 9 = 0").select(F.col("full_path").alias("old_path"), F.concat(F.lit("Z:\\moved\\"), F.col("mft_reference").cast("string"), F.lit(".bin")).alias("new_path"))).select("full_path", "name", "mft_reference"), "SELECT CASE WHEN m THEN concat('Z:', chr(92), 'moved', chr(92), mft_reference, '.bin') ELSE full_path END AS full_path, CASE WHEN m THEN concat(mft_reference, '.bin') ELSE name END AS name, CASE WHEN NOT m THEN mft_reference END AS mft_reference FROM (SELECT *, NOT is_directory AND mft_reference % 9 = 0 AS m FROM files)")
_applied = lambda v: v("changes").withColumn("scanned_at", F.col("ts").cast("timestamp"))
_advanced = lambda df: df.select("id", "last_usn", F.unix_timestamp("last_scan_time").alias("scanned"))
ADVANCED = "SELECT id, greatest(last_usn, u) AS last_usn, CAST(floor(epoch(t)) AS BIGINT) AS scanned FROM volumes LEFT JOIN (SELECT volume_id AS v, max(usn) AS u, max(ts) AS t FROM changes {} GROUP BY 1) ON v = id"
query("advance_checkpoint", "volumes changes", lambda v: _advanced(M.advance_checkpoint(v("volumes"), _applied(v))), ADVANCED.format(""))
query("advance_checkpoint_by_drive", "volumes changes", lambda v: _advanced(M.advance_checkpoint(v("volumes"), _applied(v).where("volume_id <> 2").select("usn", "scanned_at", F.concat(F.char(F.col("volume_id") + 98), F.lit(":\\")).alias("drive")))), ADVANCED.format("WHERE volume_id <> 2"))
query("set_online", "volumes", lambda v: M.set_online(v("volumes"), 5, True).select("id", "is_online"), "SELECT id, is_online OR id = 5 AS is_online FROM volumes")
query("prune", "files listing", lambda v: M.prune(v("files"), v("listing"))[0].select("full_path", "size"), f", {BELOW} SELECT full_path, size FROM b WHERE {KEPT}")
query("prune_removed", "files listing", lambda v: M.prune(v("files"), v("listing"), [1, 2])[1].select("full_path", "size"), f", {BELOW} SELECT full_path, size FROM b WHERE volume_id IN (1, 2) AND {REMOVED}")
query("prune_stats", "files listing", lambda v: M.prune_stats(M.flag_missing(v("files"), v("listing"))), f", {BELOW} SELECT upper(substr(full_path, 1, 2)) AS volume, count(*) AS entries_checked, count(CASE WHEN NOT is_directory AND {REMOVED} THEN 1 END) AS files_removed, count(CASE WHEN is_directory AND {REMOVED} THEN 1 END) AS directories_removed, count(CASE WHEN below THEN 1 END) AS checks_skipped FROM b GROUP BY 1")
query("apply_snapshot_clean", "files", lambda v: M.apply_snapshot(v("files"), v("files").where("volume_id = 2 AND size % 2 = 0"), clean=True).select("full_path", "size"), _where("volume_id <> 2 OR size % 2 = 0"))
query("apply_snapshot_incremental", "files", lambda v: M.apply_snapshot(v("files"), _extra(v).where("size % 2 = 0"), v("files").where("mft_reference % 4 = 1").select("volume_id", "mft_reference")).select("full_path", "size"), f", d AS (SELECT * FROM ({DELTA}) WHERE size % 2 = 0) SELECT full_path, size FROM d UNION ALL SELECT full_path, size FROM files WHERE mft_reference % 4 <> 1 AND full_path NOT IN (SELECT full_path FROM d)")


def _bucketed_merge(v: Views) -> BucketedCatalog:
    """A bucketed catalog after a snapshot's rows and the references that went since."""
    stale = v("files").where("mft_reference % 4 = 1").select("volume_id", "mft_reference")
    return BucketedCatalog.written(v("files"), 16).merged(_extra(v).where("size % 2 = 0"), stale=stale)


BUCKETED = """, d AS (SELECT volume_id, mft_reference, full_path, size + 1 AS size FROM files WHERE mft_reference % 5 = 0 AND size % 2 = 1
  UNION ALL SELECT volume_id, mft_reference, concat(full_path, '.new'), size + 1 FROM files WHERE mft_reference % 5 = 0 AND size % 2 = 1),
 r AS (SELECT * FROM d UNION ALL SELECT volume_id, mft_reference, full_path, size FROM files WHERE mft_reference % 4 <> 1 AND full_path NOT IN (SELECT full_path FROM d)) """
query("upsert_files_bucketed", "files", lambda v: BucketedCatalog.written(v("files"), 16).merged(_extra(v), ("mft_reference",)).rows().select("full_path", "size"), UPSERT)
query("apply_snapshot_bucketed", "files", lambda v: _bucketed_merge(v).rows().select("volume_id", "mft_reference", "full_path", "size"), BUCKETED + "SELECT * FROM r")
query("references_bucketed", "files", lambda v: _bucketed_merge(v).references(), BUCKETED + "SELECT volume_id, mft_reference, full_path FROM r WHERE mft_reference IS NOT NULL")
query("purge_references_bucketed", "files changes volumes", lambda v: BucketedCatalog.written(v("files"), 16).without(H.stale_references(v("changes"), _after(v, 1)).select("volume_id", F.col("file_reference").alias("mft_reference"))).select("full_path", "size"), PURGED)

# Relocation
THERE = "there AS (SELECT DISTINCT lower(name) AS k FROM files WHERE NOT is_directory AND volume_id = 5 AND mft_reference % 13 = 0)"
PLAN = f"{THERE}, r AS (SELECT full_path, name, size, starts_with(lower(full_path), concat('g:', chr(92))) AS inside FROM files WHERE NOT is_directory AND {LN} LIKE '%report%'), q AS (SELECT *, row_number() OVER (PARTITION BY inside, lower(name) ORDER BY full_path) AS k FROM r), plan AS (SELECT full_path, name, size, CASE WHEN inside THEN 'in_destination' WHEN k > 1 THEN 'duplicate' WHEN lower(name) IN (SELECT k FROM there) THEN 'exists' ELSE 'move' END AS disposition FROM q)"
_there = lambda v: v("files").where("NOT is_directory AND volume_id = 5 AND mft_reference % 13 = 0").select("name")
_plan = lambda v: R.move_plan(S.search(v("files"), ["report"]), "G:\\", _there(v))
query("move_plan", "files", _plan, f", {PLAN} SELECT * FROM plan")
query("move_totals", "files", lambda v: R.move_totals(_plan(v), "C:\\dest"), f", {PLAN} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(CASE WHEN substr(full_path, 1, 1) <> 'C' THEN size END), 0) AS BIGINT) AS cross_volume_bytes FROM plan WHERE disposition = 'move'")
query("move_plan_summary", "files", lambda v: R.move_plan_summary(_plan(v)), f", {PLAN} SELECT disposition, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM plan GROUP BY 1")
query("first_per_name", "files", _files(R.first_per_name, "key", "full_path"), "SELECT lower(name) AS key, min(full_path) AS full_path FROM files WHERE NOT is_directory GROUP BY 1")
query("conflict_at_destination", "files", lambda v: R.conflict_at_destination(v("files"), _there(v)).select("full_path", "size"), f", {THERE} SELECT full_path, size FROM files WHERE NOT is_directory AND lower(name) IN (SELECT k FROM there)")
PAIRS = "pairs AS (SELECT DISTINCT u.full_path, m.unc, m.drive FROM unc_paths u JOIN path_mappings m ON starts_with(lower(u.full_path), m.unc) AND (length(u.full_path) = length(m.unc) OR substr(u.full_path, length(m.unc) + 1, 1) = chr(92)))"
_unc = lambda v: v("unc_paths").select("full_path").distinct()
query("map_prefixes", "unc_paths path_mappings", lambda v: R.map_prefixes(_unc(v), v("path_mappings")).select("full_path", "unc", "drive"), f", {PAIRS} SELECT * FROM pairs")
LONGEST = f"{PAIRS}, best AS (SELECT full_path, max_by(drive, length(unc)) AS drive, max(length(unc)) AS n FROM pairs GROUP BY 1)"
query("display_path", "unc_paths path_mappings", lambda v: R.display_path(_unc(v), v("path_mappings")), f", {LONGEST} SELECT DISTINCT u.full_path, CASE WHEN n IS NULL THEN u.full_path ELSE concat(drive, substr(u.full_path, n + 1)) END AS display_path FROM unc_paths u LEFT JOIN best b ON b.full_path = u.full_path")

# Change feed
CHANGES_V = "c AS (SELECT x.*, p.full_path AS up, v.mount_point FROM changes x LEFT JOIN scan_entries p ON p.volume_id = x.volume_id AND p.mft_reference = x.parent_reference AND p.is_directory LEFT JOIN volumes v ON v.id = x.volume_id)"
UP = "CASE WHEN up IS NOT NULL THEN up WHEN parent_reference = 5 THEN mount_point END"


def _directories(v: Views) -> DataFrame:
    return v("scan_entries").where("is_directory").select("volume_id", F.col("mft_reference").alias("ref"), F.col("full_path").alias("path"))


query("classify_changes", "changes", lambda v: H.classify_changes(v("changes")).select("usn", "kind"), "SELECT usn, CASE reason WHEN 512 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'created' END AS kind FROM changes WHERE reason IN (256, 2, 8192, 512)")
query("resolve_change_paths", "changes scan_entries volumes", lambda v: H.resolve_change_paths(v("changes"), _directories(v), v("volumes")).select("usn", "full_path"), f", {CHANGES_V} SELECT usn, concat({UP}, chr(92), name) AS full_path FROM c WHERE {UP} IS NOT NULL")
query("fold_changes", "changes", lambda v: H.fold_changes(v("changes")).select("volume_id", "file_reference", "usn", "reason"), "SELECT volume_id, file_reference, max(usn) AS usn, max_by(reason, usn) AS reason FROM changes GROUP BY 1, 2")
query("rename_pairs", "changes", lambda v: H.rename_pairs(v("changes").withColumn("reason", F.when(F.col("reason") == 2, P.RENAME_OLD).otherwise(F.col("reason")).cast("long"))).select("volume_id", "file_reference", "usn", "to_usn"), "SELECT volume_id, file_reference, usn, to_usn FROM (SELECT *, lead(reason) OVER w AS r, lead(usn) OVER w AS to_usn FROM changes WHERE reason IN (2, 8192) WINDOW w AS (PARTITION BY volume_id, file_reference ORDER BY usn)) WHERE reason = 2 AND r = 8192")
query("stale_references", "changes volumes", lambda v: H.stale_references(v("changes"), _after(v, 100)), f"SELECT DISTINCT c.volume_id, file_reference FROM changes c LEFT JOIN {AFTER.format(100)} o ON o.volume_id = c.volume_id WHERE (last_usn IS NULL OR usn > last_usn) AND reason & 4608 <> 0")
query("journal_gap", "volumes", lambda v: H.journal_gap(v("volumes").select(F.col("id").alias("volume_id"), (F.col("id") % 2).alias("journal_id"), (F.col("id") * 700).alias("first_usn")), v("volumes").where("id < 5").select(F.col("id").alias("volume_id"), F.lit(1).cast("long").alias("journal_id"), "last_usn")), "SELECT id AS volume_id, id >= 5 OR id % 2 <> 1 OR id * 700 > last_usn AS rescan_required FROM volumes")
query("volume_for_path", "files volumes", lambda v: H.volume_for_path(v("files").select(F.col("full_path").alias("path")), v("volumes").where("id <> 4")).select("path", "volume_id"), "SELECT full_path AS path, volume_id FROM files WHERE volume_id <> 4")
query("volume_for_change", "files volumes", lambda v: H.volume_for_path(v("files").where("NOT is_directory").select(F.lower("full_path").alias("path")), v("volumes")).select("path", "volume_id"), "SELECT lower(full_path) AS path, volume_id FROM files WHERE NOT is_directory")
query("event_dedupe", "watch_events", lambda v: H.event_dedupe(v("watch_events")).select("path", "kind"), "SELECT DISTINCT path, kind FROM watch_events")
query("change_rates", "changes", lambda v: H.change_rates(v("changes")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "SELECT date_trunc('hour', ts) AS window_start, volume_id, CASE reason WHEN 512 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'created' END AS kind, count(*) AS n FROM changes WHERE reason IN (256, 2, 8192, 512) GROUP BY 1, 2, 3")
query("debounce_events", "watch_events", lambda v: H.debounce_events(v("watch_events"), 43200), ", e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, seq) AS rn FROM watch_events), r AS (SELECT path, rn, ts AS first_ts, kind, 1 AS n FROM e WHERE rn = 1 UNION ALL SELECT e.path, e.rn, CASE WHEN e.ts >= r.first_ts + INTERVAL 12 HOUR THEN e.ts ELSE r.first_ts END, CASE WHEN e.ts < r.first_ts + INTERVAL 12 HOUR AND r.kind = 'created' AND e.kind = 'modified' THEN 'created' ELSE e.kind END, CASE WHEN e.ts >= r.first_ts + INTERVAL 12 HOUR THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.path = r.path AND e.rn = r.rn + 1) SELECT path, first_ts, max_by(kind, rn) AS kind, CAST(max(n) AS INTEGER) AS n FROM r GROUP BY path, first_ts")
query("apply_changes", "files changes scan_entries volumes", lambda v: H.apply_changes(v("changes"), v("files"), _directories(v), v("volumes")).select("full_path", "volume_id", "mft_reference"), f""", {CHANGES_V},
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, file_reference ORDER BY usn DESC) AS k FROM c WHERE reason IN (256, 512, 8192)) WHERE k = 1),
  live AS (SELECT * FROM (SELECT *, concat({UP}, chr(92), name) AS full_path, row_number() OVER (PARTITION BY concat({UP}, chr(92), name) ORDER BY usn DESC) AS j FROM l WHERE reason <> 512 AND {UP} IS NOT NULL) WHERE j = 1)
  SELECT full_path, volume_id, mft_reference FROM files f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.volume_id = f.volume_id AND l.file_reference = f.mft_reference) AND full_path NOT IN (SELECT full_path FROM live)
  UNION ALL SELECT full_path, volume_id, file_reference FROM live""")


#: The paths that each event of `tree_changes` gives: a directory below a known one or the root, one in it, and a file in that.
NESTED = """t AS (SELECT x.*, file_reference % 100000000 AS e FROM tree_changes x),
  top AS (SELECT t.*, concat(CASE WHEN p.full_path IS NOT NULL THEN p.full_path WHEN t.parent_reference = 5 THEN v.mount_point END, chr(92), t.name) AS up FROM t JOIN volumes v ON v.id = t.volume_id
    LEFT JOIN scan_entries p ON p.volume_id = t.volume_id AND p.mft_reference = t.parent_reference AND p.is_directory WHERE t.file_reference < 2100000000 AND (p.full_path IS NOT NULL OR t.parent_reference = 5)),
  nested AS (SELECT up AS full_path, volume_id, file_reference AS mft_reference FROM top
    UNION ALL SELECT concat(up, chr(92), 'deep_', e), volume_id, file_reference + 100000000 FROM top UNION ALL SELECT concat(up, chr(92), 'deep_', e, chr(92), 'in._', e), volume_id, file_reference + 200000000 FROM top)"""
query("apply_changes_nested", "files tree_changes scan_entries volumes", lambda v: H.apply_changes(v("tree_changes"), v("files"), _directories(v), v("volumes")).select("full_path", "volume_id", "mft_reference"), f", {NESTED} SELECT full_path, volume_id, mft_reference FROM files UNION ALL SELECT * FROM nested")


def _streamed(v: Views) -> DataFrame:
    """A log by volume, in two parts with overlapping numbers, read from each volume's offset and applied to a stored catalog."""
    store = _store(v)
    spark, where = store.spark, shared_dir(store.spark, "log")
    spark.dataSource.register(J.ChangeLog)
    start = {str(r.volume_id): r.last_usn for r in _after(v, 100).collect()}  # a row for each volume
    for part in ("is_directory", "NOT is_directory"):
        v("tree_changes").where(part).write.mode("append").partitionBy("volume_id").parquet(f"{where}/log")
    changes = spark.readStream.format("change_log").option("since", json.dumps(start)).load(f"{where}/log")
    H.apply_stream(changes, store, v("volumes"), f"{where}/offsets").awaitTermination()
    return store.read().select("full_path", "volume_id", "mft_reference")


query("apply_stream", "files tree_changes scan_entries volumes", _streamed, f""", after AS {AFTER.format(100)}, {NESTED.replace("tree_changes x)", "tree_changes x LEFT JOIN after o ON o.volume_id = x.volume_id WHERE last_usn IS NULL OR usn > last_usn)").replace("x.*", "x.usn, x.volume_id, x.file_reference, x.parent_reference, x.name")}
  SELECT full_path, volume_id, mft_reference FROM files UNION ALL SELECT * FROM nested WHERE EXISTS (SELECT 1 FROM t WHERE t.volume_id = nested.volume_id AND t.file_reference = nested.mft_reference)""")


def _resumed(v: Views) -> DataFrame:
    """Reads a log, then what was added to it since."""
    changes = v("changes").select("volume_id", "usn", "file_reference", "reason")
    where, spark = shared_dir(changes.sparkSession, "log"), changes.sparkSession
    for part in ("usn % 128 = 0", "usn % 128 <> 0"):
        changes.where(part).write.mode("append").parquet(f"{where}/log")
        kept = H.checkpointed_read(spark, f"{where}/log", changes.schema, f"{where}/state")
    return kept.groupBy("volume_id", F.col("usn") % 128 == 0).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("read").alias("reads"), F.max("usn").alias("last_usn")).select("volume_id", "n", "reads", "last_usn")


query("checkpointed_read", "changes", _resumed, "SELECT volume_id, count(*) AS n, CAST(1 AS BIGINT) AS reads, max(usn) AS last_usn FROM changes GROUP BY volume_id, usn % 128 = 0")
