"""Exact duplicates by sorting contents.

Rows are dealt in ranges of their content and sorted there, which spills to disk where a range is larger than memory; a
window then walks each range and compares every row's whole text with its neighbour's. The splitters that Spark samples for
the ranges are no whole texts, which would go through the driver: a text's place is its first 64 normalised bytes, then a
hash of all of it, then the text itself.

A group that holds much of the table is cut into slots, so that ranges can end inside it. Which texts are hot is counted
beforehand: those with more than a `4 n`th of all bytes, for n ranges, so at most 4 n texts. Their slots meet again by the
text's SHA-256 in a table of at most 4 n rows.

Null texts are empty ones, and equal to them. A null id is the smallest and the largest only where all of a group are null.
Of the rows of one text, that with the largest id stays (`keep="min"`: the smallest); rows that share text and id stay or go
together, each counted. An empty table gives an empty one; further columns are left alone, whatever their names. Texts of
any length are one value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of content that decide a row's place before the hash does, and bytes that a range should hold.
HEAD, RANGE_BYTES = 64, 64 << 20
#: What a row weighs besides its text.
ROW_BYTES = 64


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise: Callable[[Column], Column] | None = None, carry: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; `carry`: and the whole row as it came, in `row`."""
    spark, best = docs.sparkSession, {"max": F.max, "min": F.min}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    weights = stored(rows.groupBy("text_hash").agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES).cast("long")).alias("bytes")), "weights")
    total = weights.agg(F.sum("bytes")).first()[0] or 1
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_BYTES))
    hot = weights.where(F.col("bytes") * (4 * ranges) > total).select("text_hash", F.ceil(F.col("bytes") * (4.0 * ranges / total)).alias("slots"))
    slot = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.coalesce("slots", F.lit(1)))
    placed = rows.join(F.broadcast(hot), "text_hash", "left").withColumn("slot", slot).withColumn("head", F.substring(F.col("text").cast("binary"), 1, HEAD))
    place = ["head", "text_hash", "slot"]
    ordered = placed.repartitionByRange(ranges, *place).sortWithinPartitions(*place, "text")
    same = Window.partitionBy(*place, "text")
    judged = ordered.select("doc_id", best("doc_id").over(same).alias("part_id"), F.count(F.lit(1)).over(same).alias("part_size"), F.col("slots").isNotNull().alias("hot"), F.sha2("text", 256).alias("text_sha256"), *(["row"] if carry else []))
    judged = stored(judged, "judged")
    whole = judged.where("hot").groupBy("text_sha256").agg(best("doc_id").alias("whole_id"), F.count(F.lit(1)).alias("whole_size"))
    joined = judged.join(F.broadcast(whole), "text_sha256", "left")
    keep_id = F.when(F.col("hot"), F.col("whole_id")).otherwise(F.col("part_id"))
    out = ["doc_id", keep_id.alias("keep_id"), F.coalesce("whole_size", "part_size").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256"]
    return joined.select(*out, *(["row"] if carry else []))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that stay, as they came."""
    return groups(docs, id_col, text_col, keep, normalise, carry=True).where("kept").select("row.*")
