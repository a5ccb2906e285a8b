"""Counts, sizes, duplicates by stem, and reports per directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths, file_stem, parent_path

def _sum_size() -> Column:
    """Sizes are added as decimals and end at the largest long, so saturated ones don't overflow."""
    total = F.sum(F.when(~F.col("is_directory"), F.col("size").cast("decimal(38,0)")))
    return F.least(F.coalesce(total, F.lit(0).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("total_size")


def _counts() -> list[Column]:
    return [F.count(F.when(~F.col("is_directory"), 1)).alias("total_files"), F.count(F.when(F.col("is_directory"), 1)).alias("total_directories"), _sum_size()]


def catalog_stats(files: DataFrame, volumes: DataFrame) -> DataFrame:
    names = ["total_files", "total_directories", "total_size", "total_volumes"]
    zero = F.lit(0).cast("long")
    own = files.agg(*_counts()).withColumn("total_volumes", zero)
    theirs = volumes.agg(F.count(F.lit(1)).alias("total_volumes")).select(*(zero.alias(n) for n in names[:3]), "total_volumes")
    return own.unionByName(theirs).agg(*(F.max(n).alias(n) for n in names))


def volume_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("volume_id").agg(*_counts())


def volumes_with_stats(files: DataFrame, volumes: DataFrame) -> DataFrame:
    v = volumes.select(F.col("id").alias("volume_id"), "mount_point", "label", "volume_type", "is_online")
    return v.join(volume_stats(files), "volume_id", "left").fillna(0, ["total_files", "total_directories", "total_size"])


def sort_volumes(stats: DataFrame, by: str) -> DataFrame:
    order = {"label": F.coalesce("label", F.lit("")), "size": F.desc("total_size"), "files": F.desc("total_files")}[by]
    return stats.orderBy(order, "volume_id")


def max_file_id(files: DataFrame, id_col: str = "mft_reference") -> DataFrame:
    return files.agg(F.coalesce(F.max(id_col), F.lit(0).cast("long")).alias("max_id"))


def result_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count(F.when(F.col("is_directory"), 1)).alias("directories"), F.count(F.when(~F.col("is_directory"), 1)).alias("files"))


def duplicate_stems(files: DataFrame) -> DataFrame:
    """Lower-case stems (in all scripts) of two files or more."""
    return files.where("NOT is_directory").groupBy(F.lower(file_stem(F.col("name"))).alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Files of duplicate stems. Stems are counted first, so only names are shuffled for that, and a frequent stem is summed
    before; the join that follows can be split where a stem is frequent."""
    own = files.where("NOT is_directory").withColumn("stem", F.lower(file_stem(F.col("name"))))
    return own.join(duplicate_stems(files).select("stem"), "stem", "left_semi")


def duplicates_by_drive(files: DataFrame, drives: tuple[str, ...]) -> DataFrame:
    """Groups first, then the drives' files of them; groups left with one vanish."""
    here = duplicate_groups(files).where(F.upper(F.substring("full_path", 1, 1)).isin([d[:1].upper() for d in drives]))
    still = here.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("stem")
    return here.join(still, "stem", "left_semi")


def limit_duplicate_groups(groups: DataFrame, limit: int) -> DataFrame:
    """The alphabetically first groups, whole."""
    first = groups.select("stem").distinct().orderBy("stem").limit(limit)
    return groups.join(first, "stem", "left_semi")


def duplicates_summary(groups: DataFrame, limit: int) -> DataFrame:
    per = groups.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_files"), F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("not_shown"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """Sum of the sizes of the files directly in each directory."""
    return files.where("NOT is_directory").groupBy(parent_path(F.col("full_path")).alias("directory")).agg(F.sum("size").alias("size"))


def files_under_directories(files: DataFrame, directories: DataFrame) -> DataFrame:
    """directory, full_path of every file below each directory: ancestors turn the prefix join into one on equality."""
    up = files.where("NOT is_directory").select("full_path", F.explode(ancestor_paths(F.col("full_path"))).alias("directory"))
    return up.join(directories.select(F.col("full_path").alias("directory")), "directory", "left_semi")


def directory_counts(files: DataFrame, directories: DataFrame) -> DataFrame:
    counts = files.where("NOT is_directory").select(F.explode(ancestor_paths(F.col("full_path"))).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"))
    return directories.select(F.col("full_path").alias("directory")).join(counts, "directory", "left").fillna(0, ["n_files"])


def info_directories(result: DataFrame) -> DataFrame:
    """Matched directories with the direct size and the count below of matched files; no size where none is in it."""
    dirs = result.where("is_directory")
    return directory_counts(result, dirs).join(directory_sizes(result), "directory", "left")


def grouped_top_n(result: DataFrame, n: int = 20) -> DataFrame:
    """The first n files of each directory, in path order, and how many more there are."""
    rows = result.where("NOT is_directory").withColumn("directory", parent_path(F.col("full_path")))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("directory").orderBy("full_path"))).where(F.col("rn") <= n)
    total = rows.groupBy("directory").agg(F.count(F.lit(1)).alias("total"))
    return first.join(total, "directory").select("directory", "full_path", "rn", F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


def match_directories(result: DataFrame, matched: bool) -> DataFrame:
    """Directories of matched files that did, or did not, match themselves."""
    holders = result.where("NOT is_directory").select(parent_path(F.col("full_path")).alias("directory")).distinct()
    dirs = result.where("is_directory").select(F.col("full_path").alias("directory"))
    return holders.join(dirs, "directory", "left_semi" if matched else "left_anti")


def directory_state(directories: DataFrame, listing: DataFrame) -> DataFrame:
    """missing, empty or has_files, by what a listing holds directly in each directory."""
    there = listing.where("is_directory").select(F.col("full_path").alias("directory"), F.lit(True).alias("there"))
    children = listing.where("NOT is_directory").groupBy(parent_path(F.col("full_path")).alias("directory")).agg(F.count(F.lit(1)).alias("n"))
    out = directories.select(F.col("full_path").alias("directory")).join(there, "directory", "left").join(children, "directory", "left")
    return out.select("directory", F.when(F.col("there").isNull(), "missing").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("has_files").alias("state"))


def report_grouped(result: DataFrame, listing: DataFrame, n: int = 20) -> DataFrame:
    """matched, directory, state, n_below, full_path, rn, more: first the directories that match, each with the first n of its
    matching files and the number of those anywhere below it, then the other directories that hold matching files.

    state is files, or, for a matching directory that has none of them, no_match or empty by what the listing holds in it; one
    that the listing lacks is missing, and its files are not shown. Directories without files are one row without a path."""
    dirs = result.where("is_directory").select("full_path").distinct()
    own = directory_state(dirs, listing).withColumnRenamed("state", "there").join(directory_counts(result, dirs).withColumnRenamed("n_files", "n_below"), "directory")
    rows = own.withColumn("matched", F.lit(True)).join(grouped_top_n(result, n), "directory", "full_outer")
    gone = F.coalesce(F.col("there") == "missing", F.lit(False))
    state = F.when(gone, "missing").when(F.col("full_path").isNotNull(), "files").when(F.col("there") == "empty", "empty").otherwise("no_match")
    shown = [F.when(~gone, F.col(c)).alias(c) for c in ("full_path", "rn", "more")]
    out = rows.where(~gone | F.coalesce(F.col("rn") == 1, F.lit(True))).select(F.coalesce("matched", F.lit(False)).alias("matched"), "directory", state.alias("state"), "n_below", *shown)
    return out.orderBy(F.desc("matched"), "directory", "rn")


def report(result: DataFrame, names_only: bool = False) -> DataFrame:
    """Directories, then files, each in order."""
    out = result.select("is_directory", F.col("name" if names_only else "full_path").alias("shown"), "full_path")
    return out.orderBy(F.desc("is_directory"), F.lower("shown") if names_only else "shown", "full_path").select("is_directory", "shown")


def report_info(result: DataFrame) -> DataFrame:
    dirs = info_directories(result).select(F.lit(True).alias("is_directory"), F.col("directory").alias("full_path"), "size", "n_files")
    files = result.where("NOT is_directory").select("is_directory", "full_path", "size", F.lit(None).cast("long").alias("n_files"))
    return dirs.unionByName(files).orderBy(F.desc("is_directory"), "full_path")


def scan_summary(files: DataFrame) -> DataFrame:
    return files.rollup("volume_id").agg(F.count(F.lit(1)).alias("n"))
