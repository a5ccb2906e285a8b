"""A catalog in buckets: changes of any size are dealt to the catalog's buckets, and no catalog row is shuffled.

Two tables. Rows lie in buckets of the hash of full_path, sorted by it. References, (volume_id, mft_reference, full_path) of the
rows that have one, lie in buckets of the hash of the first two, so a list of stale references finds its paths where they are.
A merge joins each bucket with its part of the change and writes that bucket of the next pair of tables; only the change, and
what it removes, moves. A table is a folder that is written once; the session's catalog holds its name, and `opened` enters
folders that another session wrote. The number of buckets stays the same from merge to merge: it is chosen by the first
writer, for buckets of `ROWS_PER_BUCKET` rows if none is given.

A path is there once. A null path is no key: a catalog or a change with one fails. Rows without a reference or a volume are in
the first table alone. Empty catalogs and changes are allowed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.maintain import upsert
from ..session import shared_dir

PATH, REFERENCE = ("full_path",), ("volume_id", "mft_reference")
INDEX = (*REFERENCE, *PATH)
#: Rows of a bucket, about, where the number of buckets isn't given: some 128 MB of Parquet.
ROWS_PER_BUCKET = 2_000_000


def _enter(spark: SparkSession, where: str, schema: StructType, key: tuple[str, ...], buckets: int) -> str:
    """A name in the session's catalog for a folder of bucketed files."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(key)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return name


def _write(rows: DataFrame, where: str, key: tuple[str, ...], buckets: int) -> None:
    """Rows that are dealt already, as a merge leaves them, go to a file for each bucket."""
    name = f"written_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, *key).sortBy(*key).option("path", where).format("parquet").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the name alone: the files are below a folder of ours


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("full_path", F.when(F.col("full_path").isNull(), F.raise_error(F.lit("a row has no path")).cast("string")).otherwise(F.col("full_path")))


def _referred(rows: DataFrame) -> DataFrame:
    return rows.select(*INDEX).where("volume_id IS NOT NULL AND mft_reference IS NOT NULL")


@dataclass(frozen=True)
class BucketedCatalog:
    spark: SparkSession
    where: str
    schema: StructType
    buckets: int
    names: tuple[str, str]

    @classmethod
    def written(cls, rows: DataFrame, buckets: int | None = None, where: str | None = None) -> BucketedCatalog:
        """Both tables from rows in any order: the one time that all rows are shuffled."""
        spark, where = rows.sparkSession, where or shared_dir(rows.sparkSession, "buckets")
        if buckets is None:
            buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
        _write(_keyed(rows).repartition(buckets, *PATH), f"{where}/rows", PATH, buckets)
        _write(_referred(rows).repartition(buckets, *REFERENCE), f"{where}/references", REFERENCE, buckets)
        return cls.opened(spark, where, rows.schema, buckets)

    @classmethod
    def opened(cls, spark: SparkSession, where: str, schema: StructType, buckets: int) -> BucketedCatalog:
        """The tables of a folder that `written` or `merged` made, here or in another session."""
        index = StructType([schema[c] for c in INDEX])
        return cls(spark, where, schema, buckets, (_enter(spark, f"{where}/rows", schema, PATH, buckets), _enter(spark, f"{where}/references", index, REFERENCE, buckets)))

    def rows(self) -> DataFrame:
        return self.spark.table(self.names[0])

    def references(self) -> DataFrame:
        return self.spark.table(self.names[1])

    def stale_paths(self, stale: DataFrame) -> DataFrame:
        """The paths of stale references (volume_id, mft_reference; those of a change feed repeat, and are made few first)."""
        return self.references().join(stale.select(*REFERENCE).distinct(), list(REFERENCE), "left_semi").select(*PATH)

    def without(self, stale: DataFrame) -> DataFrame:
        """The rows without those of stale references."""
        return self.rows().join(self.stale_paths(stale), "full_path", "left_anti")

    def upserted(self, delta: DataFrame, keep: tuple[str, ...] = (), stale: DataFrame | None = None) -> DataFrame:
        """The rows of `maintain.apply_snapshot`: without stale references, then `delta` over them by path."""
        old = self.rows() if stale is None else self.without(stale)
        return upsert(old, _keyed(delta.select(*self.schema.names)), "full_path", keep)

    def merged(self, delta: DataFrame, keep: tuple[str, ...] = (), stale: DataFrame | None = None, where: str | None = None) -> BucketedCatalog:
        """The next pair of tables, bucket by bucket."""
        where = where or shared_dir(self.spark, "buckets")
        _write(self.upserted(delta, keep, stale), f"{where}/rows", PATH, self.buckets)
        # What the change touched, by the tables before and after it: no more rows than the change has.
        touched = delta.select(*PATH) if stale is None else delta.select(*PATH).unionByName(self.stale_paths(stale))
        after = BucketedCatalog(self.spark, where, self.schema, self.buckets, (_enter(self.spark, f"{where}/rows", self.schema, PATH, self.buckets), ""))
        had, has = (_referred(t.rows().join(touched, "full_path", "left_semi")) for t in (self, after))
        gone = had.groupBy(*REFERENCE).agg(F.collect_set("full_path").alias("gone"))  # paths of one reference: its hard links
        left = self.references().join(gone, list(REFERENCE), "left").where("gone IS NULL OR NOT array_contains(gone, full_path)").select(*INDEX)
        _write(left.unionByName(has.repartition(self.buckets, *REFERENCE)), f"{where}/references", REFERENCE, self.buckets)
        return BucketedCatalog.opened(self.spark, where, self.schema, self.buckets)
