"""Relocation plans and path mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import SLASH, classify_path, drive_letter, normalize_extended, volume_prefix


def move_plan(result: DataFrame, destination: str, there: DataFrame, force: bool = False) -> DataFrame:
    """disposition of each file of a result, in path order: in_destination, duplicate (a name seen before), exists (at the
    destination, unless forced), move. `there`: names at the destination."""
    rows = result.where("NOT is_directory").select("full_path", "name", "size")
    inside = normalize_extended(F.col("full_path")).startswith(destination.lower().rstrip(SLASH) + SLASH)
    rows = rows.withColumn("inside", inside).withColumn("key", F.lower("name"))
    # The first of each name, by aggregate and join: a name held by many is reduced before the shuffle.
    first = rows.where("NOT inside").groupBy("key").agg(F.min("full_path").alias("first"))
    taken = there.select(F.lower("name").alias("key"), F.lit(True).alias("taken")).distinct()
    planned = rows.join(first, "key", "left").join(taken, "key", "left")
    kind = F.when(F.col("inside"), "in_destination").when(F.col("first") != F.col("full_path"), "duplicate").when(F.col("taken") & F.lit(not force), "exists").otherwise("move")
    return planned.select("full_path", "name", "size", kind.alias("disposition"))


def first_per_name(result: DataFrame) -> DataFrame:
    return result.where("NOT is_directory").groupBy(F.lower("name").alias("key")).agg(F.min("full_path").alias("full_path"))


def move_totals(plan: DataFrame, destination: str) -> DataFrame:
    """Bytes to move, and those from another volume than the destination's; an unknown volume is another."""
    own = plan.sparkSession.range(1).select(volume_prefix(F.lit(destination)).alias("p")).first()[0]
    same = F.coalesce(volume_prefix(F.col("full_path")) == F.lit(own), F.lit(False)) if own else F.lit(False)
    moved = plan.where("disposition = 'move'")
    return moved.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(~same, F.col("size"))), F.lit(0)).alias("cross_volume_bytes"))


def move_plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def conflict_at_destination(result: DataFrame, there: DataFrame) -> DataFrame:
    return result.where("NOT is_directory").join(there.select(F.lower("name").alias("_k")).distinct(), F.lower("name") == F.col("_k"), "left_semi")


def map_prefixes(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pairs of path and mapping (unc, drive) where the path starts with the prefix, in any case. Prefixes of server and
    share, and longer, are looked up by equality with the path's own prefixes of as many parts."""
    parts = F.split(F.lower("full_path"), r"\\")
    ups = F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda i: F.array_join(F.slice(parts, 1, i), SLASH))
    return paths.withColumn("unc", F.explode(F.array_distinct(ups))).join(mappings, "unc")


def display_path(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """full_path and display_path: the longest mapped prefix replaced, the rest in its own case; unmapped paths as they are."""
    best = map_prefixes(paths.select("full_path"), mappings).groupBy("full_path").agg(F.max_by(F.struct("unc", "drive"), F.length("unc")).alias("m"))
    return paths.join(best, "full_path", "left").withColumn("display_path", F.when(F.col("m").isNull(), F.col("full_path")).otherwise(F.concat("m.drive", F.substring("full_path", F.length("m.unc") + 1, F.length("full_path"))))).drop("m")


def classify_paths(paths: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds path_class; drives of network volumes are mapped ones. Volumes are a small dimension."""
    mapped = volumes.where(F.lower("volume_type") == "network").select(F.upper(F.substring("mount_point", 1, 1)).alias("_drive")).distinct()
    return paths.join(mapped, drive_letter(F.col("full_path")) == F.col("_drive"), "left").withColumn("path_class", classify_path(F.col("full_path"), F.col("_drive").isNotNull())).drop("_drive")
