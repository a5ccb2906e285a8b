"""Catalog maintenance as functions from old rows and changes to new rows; a writer publishes versions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths, volume_key
from .tree import in_subtree


def latest_per_path(rows: DataFrame, order: str, key: str = "full_path") -> DataFrame:
    """The last row of each path; a group's largest row is an aggregate, so paths written often are reduced before the shuffle."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in names)).select(*rows.columns)


#: Bytes of a delta, as `is_small` counts them, that go to every task.
SMALL = 8 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its texts, and 16 for each column."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return reduce(add, texts, F.lit(16 * len(df.columns))).cast("long")


def is_small(delta: DataFrame, limit: int = SMALL) -> bool:
    """Whether the rows, counted now, are few enough to be sent to every task."""
    return (delta.agg(F.sum(row_bytes(delta))).first()[0] or 0) <= limit


def upsert(old: DataFrame, delta: DataFrame, key: str, keep: tuple[str, ...] = (), small: bool = False) -> DataFrame:
    """Rows of `delta` replace those of their key, but for the columns in `keep`, or are new. Keys of `delta` are unique.

    With `small`, which `is_small` tells, the delta goes to every task and the old rows stay where they are: no more of them
    than the delta has rows, and of those the keys alone, move. Without, both sides are dealt by the key."""
    names = [c for c in old.columns if c != key]
    a, b = old.alias("a"), delta.withColumn("_new", F.lit(True)).alias("b")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in keep else F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    met = a.join(F.broadcast(b) if small else b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left" if small else "full_outer")
    out = met.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(pick(c).alias(c) for c in names)).select(*old.columns)
    if not small:
        return out
    there = old.select(key).join(F.broadcast(delta.select(key)), key, "left_semi")
    return out.unionByName(delta.join(there, key, "left_anti").select(*old.columns))


def assign_ids(rows: DataFrame, id_col: str, largest: int) -> DataFrame:
    """Numbers above the largest for rows without an id: by hash bucket first, so that no task sorts them all."""
    new = rows.where(F.col(id_col).isNull()).withColumn("_b", F.pmod(F.xxhash64("full_path"), F.lit(1024)))
    sizes = new.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("_b").orderBy("full_path"))
    numbered = new.join(sizes, "_b").withColumn(id_col, F.lit(largest) + F.col("_before") + n).select(*rows.columns)
    return rows.where(F.col(id_col).isNotNull()).unionByName(numbered)


def delete_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("full_path") != path)


def delete_volume_rows(files: DataFrame, volume_id: int) -> DataFrame:
    return files.where(F.col("volume_id") != volume_id)


def delete_subtree(files: DataFrame, path: str, case_insensitive: bool = False) -> DataFrame:
    return files.where(~in_subtree(files, path, case_insensitive))


def delete_keys(files: DataFrame, keys: DataFrame, *on: str, small: bool = False) -> DataFrame:
    """Without the rows whose key is in a table: (volume_id, mft_reference), id, or any other. `small` as in `upsert`."""
    gone = keys.select(*on)
    return files.join(F.broadcast(gone) if small else gone, list(on), "left_anti")


def relocate_path(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Moved rows (old_path, new_path) get path and name and lose their reference; rows at a target are replaced."""
    left = files.join(moves.select(F.col("new_path").alias("full_path")), "full_path", "left_anti")
    m = moves.select(F.col("old_path").alias("full_path"), "new_path")
    moved = left.join(m, "full_path", "left")
    hit = F.col("new_path").isNotNull()
    name = F.regexp_extract("new_path", r"([^\\/]+)$", 1)
    return moved.withColumn("full_path", F.coalesce("new_path", "full_path")).withColumn("name", F.when(hit, name).otherwise(F.col("name"))).withColumn("mft_reference", F.when(~hit, F.col("mft_reference"))).select(*files.columns)


def advance_checkpoint(volumes: DataFrame, applied: DataFrame) -> DataFrame:
    """last_usn of each volume of `applied` becomes the largest applied, never a smaller one, and last_scan_time the latest.
    `applied` has volume_id, or drive (C: or C:\\, in any case), and usn, and may have scanned_at."""
    letter = lambda c: F.upper(F.substring(c, 1, 2))
    by_id = "volume_id" in applied.columns
    scanned = F.max("scanned_at") if "scanned_at" in applied.columns else F.lit(None).cast("timestamp")
    last = applied.groupBy((F.col("volume_id") if by_id else letter("drive")).alias("key")).agg(F.max("usn").alias("usn"), scanned.alias("at"))
    joined = volumes.join(last, volumes["id"] == last["key"] if by_id else letter(volumes["mount_point"]) == last["key"], "left")
    new = {"last_usn": F.greatest(volumes["last_usn"], last["usn"]), "last_scan_time": F.greatest(volumes["last_scan_time"], last["at"])} if "last_scan_time" in volumes.columns else {"last_usn": F.greatest(volumes["last_usn"], last["usn"])}
    return joined.select(*(new.get(c, volumes[c]).alias(c) for c in volumes.columns))


def set_online(volumes: DataFrame, volume_id: int, online: bool) -> DataFrame:
    return volumes.withColumn("is_online", F.when(F.col("id") == volume_id, F.lit(online)).otherwise(F.col("is_online")))


def missing_entries(files: DataFrame, listing: DataFrame) -> DataFrame:
    return files.join(listing.select("full_path"), "full_path", "left_anti")


def checked(files: DataFrame, volume_ids: list[int] | None, max_id: int | None, id_col: str = "mft_reference") -> Column:
    test = F.lit(True) if volume_ids is None else F.col("volume_id").isin(volume_ids)
    return test if max_id is None else test & (F.col(id_col) <= max_id)


def flag_missing(files: DataFrame, listing: DataFrame, volume_ids: list[int] | None = None, max_id: int | None = None, force: bool = False) -> DataFrame:
    """The rows with `gone` (the listing lacks it, or a directory above it) and `below` (a missing directory is above it).

    Volumes without any row in the listing are left alone unless `force`, as they may be offline. Ancestors are looked up
    once, among the missing directories alone."""
    test = checked(files, volume_ids, max_id)
    seen = listing.select(volume_key(F.col("full_path")).alias("_seen")).distinct()
    on_volume = lambda df, how: df.join(seen, volume_key(F.col("full_path")) == F.col("_seen"), how)
    dirs = files.where(F.col("is_directory") & test).select("full_path")
    missing = (dirs if force else on_volume(dirs, "left_semi")).join(listing.select("full_path"), "full_path", "left_anti")
    below = files.select("full_path", F.explode(ancestor_paths(F.col("full_path"))).alias("above")).join(missing.select(F.col("full_path").alias("above")), "above", "left_semi").select("full_path", F.lit(True).alias("_below")).distinct()
    rows = files.join(listing.select("full_path", F.lit(True).alias("_there")), "full_path", "left").join(below, "full_path", "left")
    rows = rows.withColumn("_seen", F.lit("")) if force else on_volume(rows, "left")
    asked = test & F.col("_seen").isNotNull()
    lost = F.coalesce(F.col("_below"), F.lit(False))
    return rows.select(*files.columns, (asked & (F.col("_there").isNull() | lost)).alias("gone"), (asked & lost).alias("below"))


def prune(files: DataFrame, listing: DataFrame, volume_ids: list[int] | None = None, max_id: int | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows: those that a listing lacks go, and all below missing directories (`flag_missing`)."""
    rows = flag_missing(files, listing, volume_ids, max_id, force)
    return rows.where("NOT gone").select(*files.columns), rows.where("gone").select(*files.columns)


def prune_stats(flagged: DataFrame) -> DataFrame:
    """Per volume: rows looked at, files and directories removed, and checks that a missing directory above saves."""
    total = lambda test: F.count(F.when(test, 1))
    own = flagged.groupBy(volume_key(F.col("full_path")).alias("volume"))
    return own.agg(F.count(F.lit(1)).alias("entries_checked"), total(F.col("gone") & ~F.col("is_directory")).alias("files_removed"), total(F.col("gone") & F.col("is_directory")).alias("directories_removed"), total(F.col("below")).alias("checks_skipped"))


def apply_snapshot(catalog: DataFrame, snapshot: DataFrame, stale: DataFrame | None = None, clean: bool = False, small: bool = False) -> DataFrame:
    """A volume's snapshot: in place of its rows (clean), or over them, without references that went since (stale). `small`
    is about both."""
    if clean:
        return catalog.join(snapshot.select("volume_id").distinct(), "volume_id", "left_anti").select(*catalog.columns).unionByName(snapshot.select(*catalog.columns))
    left = catalog if stale is None else delete_keys(catalog, stale, "volume_id", "mft_reference", small=small).select(*catalog.columns)
    return upsert(left, snapshot.select(*catalog.columns), "full_path", small=small)


def needs_full_scan(files: DataFrame, forced: bool = False) -> DataFrame:
    """One row, needed: whether a scan was asked for, or the catalog has neither files nor directories. Reads one row."""
    return files.limit(1).agg(((F.count(F.lit(1)) == 0) | F.lit(forced)).alias("needed"))
