"""Change feeds: batch forms, and the streams that use them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.paths import DELETE, RENAME_NEW, RENAME_OLD, SLASH, event_kind, has_flag
from ..session import cut
from ..sources.journal import since
from ..sources.store import CatalogStore


def classify_changes(changes: DataFrame) -> DataFrame:
    """Adds kind; changes without one go. Stateless, for streams too."""
    return changes.withColumn("kind", event_kind(F.col("reason"))).where("kind IS NOT NULL")


def resolve_change_paths(changes: DataFrame, directories: DataFrame, volumes: DataFrame, root_ref: int = 5) -> DataFrame:
    """Adds full_path from the parent directory (volume_id, ref, path), or the mount point of the volume for its root;
    unresolved changes go. References are told per volume, as each volume counts its own."""
    found = changes.join(directories.select("volume_id", F.col("ref").alias("parent_reference"), F.col("path").alias("_p")), ["volume_id", "parent_reference"], "left")
    drives = volumes.select(F.col("id").alias("volume_id"), F.regexp_replace("mount_point", r"[\\/]+$", "").alias("_drive"))
    up = F.coalesce("_p", F.when(F.col("parent_reference") == root_ref, F.col("_drive")))
    return found.join(drives, "volume_id", "left").withColumn("full_path", F.concat_ws(SLASH, up, "name")).where(up.isNotNull()).drop("_p", "_drive")


#: What tells a file: references begin anew on every volume.
FILE = ("volume_id", "file_reference")


def fold_changes(changes: DataFrame) -> DataFrame:
    """The last record of each file, by usn."""
    rest = [c for c in changes.columns if c not in FILE]
    last = changes.groupBy(*FILE).agg(F.max_by(F.struct(*rest), "usn").alias("r"))
    return last.select(*FILE, *(F.col(f"r.{c}").alias(c) for c in rest))


def rename_pairs(changes: DataFrame) -> DataFrame:
    """Each old-name record with the next new-name record of its file, where that is the next one."""
    w = Window.partitionBy(*FILE).orderBy("usn")
    rows = changes.where(has_flag(F.col("reason"), RENAME_OLD | RENAME_NEW)).withColumn("n_reason", F.lead("reason").over(w)).withColumn("to_name", F.lead("name").over(w)).withColumn("to_usn", F.lead("usn").over(w))
    return rows.where(has_flag(F.col("reason"), RENAME_OLD) & has_flag(F.col("n_reason"), RENAME_NEW)).select(*FILE, "usn", "to_usn", F.col("name").alias("from_name"), "to_name")


def rename_stream(changes: DataFrame, hold_ms: int):
    """The same on a stream of records with ts (and a watermark on it), by keyed state and event-time timers. Records wait until
    the watermark passes them, so those that come in another order, or in other micro-batches, meet by usn; ts is to follow
    usn. An old name whose new name has not come `hold_ms` later is let go. Needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Renames(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "usn long", "ts long, old boolean, new boolean, name string")
            self.open = handle.getValueState("open", "usn long, ts long, name string")

        def handleInputRows(self, key, rows, timerValues):
            for r in pd.concat(list(rows)).itertuples():
                if r.reason & (RENAME_OLD | RENAME_NEW):
                    ms = int(r.ms)
                    self.waiting.updateValue((int(r.usn),), (ms, bool(r.reason & RENAME_OLD), bool(r.reason & RENAME_NEW), r.name))
                    self.handle.registerTimer(ms + 1)
            yield self._rows(key, [])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now, out = timerValues.getCurrentWatermarkInMs(), []
            held = self.open.get() if self.open.exists() else None
            for (usn,), (ms, old, new, name) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
                if ms >= now:
                    break  # an earlier record may still come
                if held is not None and new and ms <= held[1] + hold_ms:
                    out.append((held[0], usn, held[2], name))
                held = (usn, ms, name) if old else None
                self.waiting.removeKey((usn,))
            if held is not None and held[1] + hold_ms < now:
                held = None
            if held is None:
                self.open.clear()
            else:
                self.open.update(held)
                self.handle.registerTimer(held[1] + hold_ms + 1)
            yield self._rows(key, out)

        def _rows(self, key, rows):
            usn, to, a, b = zip(*rows) if rows else ((), (), (), ())
            n = len(rows)
            return pd.DataFrame({"volume_id": pd.Series([key[0]] * n, dtype="int64"), "file_reference": pd.Series([key[1]] * n, dtype="int64"), "usn": pd.Series(usn, dtype="int64"), "to_usn": pd.Series(to, dtype="int64"), "from_name": pd.Series(a, dtype=object), "to_name": pd.Series(b, dtype=object)})

        def close(self):
            pass

    schema = "volume_id long, file_reference long, usn long, to_usn long, from_name string, to_name string"
    return changes.select(*FILE, "usn", "reason", "name", "ts", F.unix_millis("ts").alias("ms")).groupBy(*FILE).transformWithStateInPandas(statefulProcessor=Renames(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stale_references(changes: DataFrame, offsets: DataFrame) -> DataFrame:
    """volume_id, file_reference of what was deleted or had its name taken away after its volume's offset (volume_id, last_usn)."""
    return since(changes, offsets).where(has_flag(F.col("reason"), DELETE | RENAME_OLD)).select(*FILE).distinct()


def journal_gap(meta: DataFrame, stored: DataFrame) -> DataFrame:
    """volume_id, rescan_required: whether a journal is another than stored, or has lost what follows the stored offset."""
    s = stored.select("volume_id", F.col("journal_id").alias("_id"), "last_usn")
    return meta.join(s, "volume_id", "left").select("volume_id", (F.col("_id").isNull() | (F.col("journal_id") != F.col("_id")) | (F.col("first_usn") > F.col("last_usn"))).alias("rescan_required"))


def volume_for_path(events: DataFrame, volumes: DataFrame, column: str = "path") -> DataFrame:
    """Adds volume_id by drive letter and colon, in any case; others go. Volumes are a small dimension."""
    v = volumes.select(F.col("id").alias("volume_id"), F.upper("mount_point").alias("_m"))
    return events.join(v, F.upper(F.substring(column, 1, 2)) == F.col("_m")).drop("_m")


def event_dedupe(events: DataFrame, within: str | None = None) -> DataFrame:
    """One event of each path and kind. `within`, for streams: an event that comes again within that time is dropped, and its
    state goes once the watermark on ts has passed it by that time."""
    if within is None:
        return events.dropDuplicates(["path", "kind"])
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["path", "kind"])


def change_rates(changes: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Changes per window, volume and kind. `late`, for streams: how late a change may come; in append mode a window is told once
    the watermark has passed its end, later changes are dropped."""
    timed = changes if late is None else changes.withWatermark("ts", late)
    counted = classify_changes(timed).groupBy(F.window("ts", window).alias("w"), "volume_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "volume_id", "kind", "n")


def _debounce(step: int):
    """Folds events that come by path, ts (microseconds) and seq; one window is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = None, ["path", "first_ts", "kind", "n"]

        def made(done: list, kind: pa.DataType) -> pa.RecordBatch:
            path, ts, kinds, n = zip(*done) if done else ((), (), (), ())
            return pa.record_batch([pa.array(path, pa.string()), pa.array(ts, pa.int64()).cast(kind), pa.array(kinds, pa.string()), pa.array(n, pa.int32())], names=names)

        for batch in batches:
            done, stamp = [], batch.column(1).type
            for path, ts, kind in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist()):
                if now is not None and now[0] == path and (ts is None or now[1] is None or ts < now[1] + step):
                    now = (path, now[1], "created" if (now[2], kind) == ("created", "modified") else kind, now[3] + 1)
                    continue
                if now is not None:
                    done.append(now)
                now = (path, ts, kind, 1)
            yield made(done, stamp)
        if now is not None:
            yield made([now], stamp)

    return run


def debounce_events(events: DataFrame, seconds: int) -> DataFrame:
    """Batch form: a path's window opens at its first event and is not extended; created then modified stays created, else
    the latest kind counts. Columns path, first_ts, kind, n. A path's events pass one task in order, but are never held."""
    ordered = events.select("path", "ts", "kind", "seq").repartition("path").sortWithinPartitions("path", "ts", "seq")
    return ordered.mapInArrow(_debounce(seconds * 1_000_000), f"path string, first_ts {events.schema['ts'].dataType.simpleString()}, kind string, n int")


def debounce_stream(events: DataFrame, milliseconds: int):
    """The same on a stream of path, ts (with a watermark), seq, kind, by a stateful processor with event-time timers. Needs
    the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Debounce(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getValueState("open", "first_ts long, kind string, n int")

        def handleInputRows(self, key, rows, timerValues):
            events = pd.concat(list(rows)).sort_values(["ts", "seq"])
            now, out = self.open.get() if self.open.exists() else None, []
            for ts, kind in zip(events["ts"].astype("datetime64[ms]").astype("int64"), events["kind"]):
                if now is not None and ts < now[0] + milliseconds:
                    now = (now[0], "created" if (now[1], kind) == ("created", "modified") else kind, now[2] + 1)
                    continue
                if now is not None:
                    out.append((key[0], *now))
                    self.handle.deleteTimer(now[0] + milliseconds)
                now = (ts, kind, 1)
                self.handle.registerTimer(ts + milliseconds)
            self.open.update(now)
            yield self._rows(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = self.open.get() if self.open.exists() else None
            if now is not None and now[0] + milliseconds <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._rows([(key[0], *now)])

        def _rows(self, rows):
            return pd.DataFrame({"path": pd.Series([r[0] for r in rows], dtype=object), "first_ts": pd.to_datetime(pd.Series([r[1] for r in rows], dtype="int64"), unit="ms"), "kind": pd.Series([r[2] for r in rows], dtype=object), "n": pd.Series([r[3] for r in rows], dtype="int32")})

        def close(self):
            pass

    return events.groupBy("path").transformWithStateInPandas(statefulProcessor=Debounce(), outputStructType="path string, first_ts timestamp, kind string, n int", outputMode="Append", timeMode="EventTime")


def directories_after(last: DataFrame, directories: DataFrame, volumes: DataFrame, root_ref: int = 5, max_depth: int = 256) -> DataFrame:
    """volume_id, ref, path of the directories once a batch is applied: those given that the batch leaves alone, and those that
    it creates or renames, also below one another. `last` is the last record of each file.

    The batch's own directories are joined to one another by doubling, so a chain of 256 takes eight rounds; what then stands
    at their top is looked up once. A chain that ends nowhere, or in a cycle, has no path."""
    known = directories.select("volume_id", "ref", "path").join(last.select("volume_id", F.col("file_reference").alias("ref")), ["volume_id", "ref"], "left_anti")
    made = cut(last.where((event_kind(F.col("reason")) == "created") & F.col("is_directory")).select("volume_id", F.col("file_reference").alias("ref"), F.col("parent_reference").alias("up"), F.col("name").alias("path")))
    reach = 1
    while reach < max_depth:
        above = made.select("volume_id", F.col("ref").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        joined = cut(made.join(above, ["volume_id", "up"], "left"))
        if joined.where("_up IS NOT NULL").isEmpty():
            break
        made = joined.select("volume_id", "ref", F.coalesce("_up", "up").alias("up"), F.concat_ws(SLASH, "_path", "path").alias("path"))
        reach *= 2
    whole = resolve_change_paths(made.select("volume_id", "ref", F.col("up").alias("parent_reference"), F.col("path").alias("name")), known, volumes, root_ref)
    return known.unionByName(whole.select("volume_id", "ref", F.col("full_path").alias("path")))


def _known_directories(catalog: DataFrame) -> DataFrame:
    return catalog.where("is_directory AND mft_reference IS NOT NULL").select("volume_id", F.col("mft_reference").alias("ref"), F.col("full_path").alias("path"))


def apply_changes(batch: DataFrame, catalog: DataFrame, directories: DataFrame | None, volumes: DataFrame, update_modified: bool = False) -> DataFrame:
    """The catalog after a batch: the last record of each (volume, reference) decides. Deleted and old-named references go,
    created and new-named ones are at their path, under which nothing else stays; directories of the batch count when paths
    are looked up, whatever the order of records (`directories`: volume_id, ref, path; by default the catalog's own). Modified
    ones change nothing, or with `update_modified` their size, where the batch has one. Applying a batch again gives the same
    rows, so a stream may repeat one."""
    keys, record = list(FILE), F.col("reason")
    rest = [c for c in batch.columns if c not in keys]
    newest = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "usn").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
    last = newest(batch.where(~event_kind(record).isin("modified") | has_flag(record, RENAME_OLD)))
    folders = directories_after(last, _known_directories(catalog) if directories is None else directories, volumes)
    live = resolve_change_paths(last.where(event_kind(record) == "created"), folders, volumes)
    sized = "size" in batch.columns
    live = live.withColumn("size", F.coalesce("size", F.lit(0)).cast("long") if sized else F.lit(0).cast("long"))
    live = live.groupBy("full_path").agg(F.max_by(F.struct("volume_id", "file_reference", "name", "is_directory", "size"), "usn").alias("r")).select("full_path", "r.*")
    gone = last.select("volume_id", F.col("file_reference").alias("mft_reference"))
    left = catalog.join(gone, ["volume_id", "mft_reference"], "left_anti").join(live.select("full_path"), "full_path", "left_anti")
    if update_modified and sized:
        sizes = newest(batch.where("size IS NOT NULL")).select("volume_id", F.col("file_reference").alias("mft_reference"), F.col("size").cast("long").alias("_size"))
        left = left.join(sizes, ["volume_id", "mft_reference"], "left").withColumn("size", F.coalesce("_size", "size"))
    new = live.withColumn("mft_reference", F.col("file_reference"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in catalog.schema if f.name not in new.columns}
    return left.select(*catalog.columns).unionByName(new.select(*(empty.get(c, F.col(c)) for c in catalog.columns)))


def apply_stream(changes: DataFrame, store: CatalogStore, volumes: DataFrame, checkpoint: str, name: str = "changes", update_modified: bool = False):
    """Starts a stream that applies each micro-batch to the stored catalog, exactly once: rows of the touched volumes, their
    offsets and the batch's number become one version. A batch that is run again after its version was published changes
    nothing; one that was stopped before it is applied to the version that it began with. Records up to a volume's offset are
    left out."""

    def apply(batch: DataFrame, n: int) -> None:
        base = store.head()
        if base.batches.get(name, -1) >= n:
            return
        rows = since(batch, store.offsets(base)).persist()
        try:
            offsets = {r[0]: r[1] for r in rows.groupBy("volume_id").agg(F.max("usn")).collect()}  # a row for each volume
            after = apply_changes(rows, store.read(base, offsets), None, volumes, update_modified) if offsets else None
            store.commit(base, after, offsets, offsets, {name: n})
        finally:
            rows.unpersist()

    return change_stream(changes, apply, checkpoint)


def change_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands each micro-batch to `apply`; offsets are in the checkpoint, so a restart resumes."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpointed_read(spark: SparkSession, log: str, schema: StructType, where: str) -> DataFrame:
    """Reads what a folder of change records holds beyond the stored offset, keeps it below `where`, and returns all kept so
    far with the number of the read. A read that is repeated writes its own part again, so each record is kept once."""
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/kept/read={n}")
    change_stream(spark.readStream.schema(schema).parquet(log), keep, f"{where}/offsets").awaitTermination()
    kept = StructType([*schema.fields, StructField("read", LongType())])
    return spark.read.schema(kept).parquet(f"{where}/kept")
