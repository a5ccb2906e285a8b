"""Paths from parent pointers, and sets of rows below directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import SLASH, ancestor_paths
from ..session import cut


def resolve_paths(records: DataFrame, volumes: DataFrame, root_ref: int = 5, max_depth: int = 256) -> DataFrame:
    """mft_reference, volume_id, full_path of records with volume_id, file_reference, parent_reference, name, is_directory.
    Paths begin with the volume's mount point; records of an unknown volume have none and go.

    Only directories are resolved step by step: each round joins every directory's open end with the directory there, so a
    depth of 256 takes eight rounds. Files then take one join. Empty parent names are left out; a missing parent ends the
    path below the drive; chains longer than `max_depth`, or in a cycle, end there too.
    """
    dirs = records.where("is_directory").select("volume_id", F.col("file_reference").alias("ref"), F.when(F.col("parent_reference") != root_ref, F.col("parent_reference")).alias("up"), F.col("name").alias("path"))
    dirs, reach = cut(dirs), 1
    while reach < max_depth:
        above = dirs.select("volume_id", F.col("ref").alias("up"), F.col("path").alias("a_path"), F.col("up").alias("a_up"), F.lit(True).alias("found"))
        joined = dirs.join(above, ["volume_id", "up"], "left")
        if joined.where("found").isEmpty():
            break
        path = F.concat_ws(SLASH, F.when(F.col("a_path") != "", F.col("a_path")), F.when(F.col("path") != "", F.col("path")))
        dirs = cut(joined.select("volume_id", "ref", F.when(F.col("found"), F.col("a_up")).alias("up"), F.when(F.col("found"), path).otherwise(F.col("path")).alias("path")))
        reach *= 2
    parents = dirs.select("volume_id", F.col("ref").alias("parent_reference"), F.col("path").alias("parent_path"))
    drives = volumes.select(F.col("id").alias("volume_id"), F.regexp_replace("mount_point", r"[\\/]+$", "").alias("drive"))
    whole = F.concat_ws(SLASH, "drive", F.when(F.col("parent_path") != "", F.col("parent_path")), F.col("name"))
    return records.join(parents, ["volume_id", "parent_reference"], "left").join(drives, "volume_id").select(F.col("file_reference").alias("mft_reference"), "volume_id", whole.alias("full_path"))


def in_subtree(files: DataFrame, path: str, case_insensitive: bool = False) -> Column:
    p = path.replace("/", SLASH)
    own = F.col("full_path")
    if case_insensitive:
        p, own = p.lower(), F.lower(own)
    return (own == p) | own.startswith(p + SLASH) | own.startswith(p + "/")


def under_missing(files: DataFrame, missing_dirs: DataFrame) -> DataFrame:
    """Rows with a missing directory above them."""
    up = files.select("full_path", F.explode(ancestor_paths(F.col("full_path"))).alias("above"))
    lost = up.join(missing_dirs.select(F.col("full_path").alias("above")), "above", "left_semi").select("full_path").distinct()
    return files.join(lost, "full_path", "left_semi")


def scan_root_dedupe(roots: DataFrame) -> DataFrame:
    """Roots (path) without those on a drive whose own root is among them."""
    clean = roots.select("path").distinct().withColumn("drive", F.upper(F.substring("path", 1, 2)))
    whole = clean.where(F.col("path").rlike(r"^[A-Za-z]:[\\/]?$")).select("drive", F.lit(True).alias("whole")).distinct()
    return clean.join(whole, "drive", "left").where(F.col("whole").isNull() | F.col("path").rlike(r"^[A-Za-z]:[\\/]?$")).select("path", "drive")
