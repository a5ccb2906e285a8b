"""Stored catalogs, change logs with an offset for each volume, and the streams that use them."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import journal
from shelfmark.sources.store import CatalogStore, Conflict
from shelfmark.streaming import changes

FILES = "full_path string, volume_id long, mft_reference long, name string, is_directory boolean, size long, created_time timestamp"
LOG = "volume_id long, usn long, ts timestamp, file_reference long, parent_reference long, name string, reason long, is_directory boolean"


def files(spark, *rows):
    return spark.createDataFrame([(p, v, r, p.rpartition("\\")[2], d, 1, None) for p, v, r, d in rows], FILES)


def volumes(spark, n):
    return spark.createDataFrame([(v, f"{chr(66 + v)}:") for v in range(1, n + 1)], "id long, mount_point string")


def log(spark, rows):
    return spark.createDataFrame(rows, "volume_id long, usn long, file_reference long, parent_reference long, name string, reason long, is_directory boolean").withColumn("ts", F.timestamp_seconds(F.col("usn") + 1_700_000_000)).select(*(c.split()[0] for c in LOG.split(", ")))


@pytest.fixture
def store(spark, tmp_path):
    s = CatalogStore(spark, str(tmp_path / "catalog"), files(spark).schema)
    s.replace(files(spark, *((f"{chr(66 + v)}:\\d{i}", v, 10 * v + i, i == 0) for v in range(1, 6) for i in range(4))))
    return s


def paths(df):
    return sorted(r[0] for r in df.select("full_path").collect())


def written(store):
    return {str(p) for p in Path(store.where).rglob("*.parquet")}


def test_a_delta_writes_the_volumes_that_it_touches(spark, store):
    before, base = written(store), store.head()
    store.upsert(files(spark, ("E:\\new", 3, 99, False), ("E:\\d1", 3, 98, False)), keep=("mft_reference",))
    new = written(store) - before
    assert new and all("/volume_id=3/" in p for p in new)
    head = store.head()
    assert {v for v in head.folders if head.folders[v] != base.folders[v]} == {3}
    assert paths(store.read(volumes=[3])) == ["E:\\d0", "E:\\d1", "E:\\d2", "E:\\d3", "E:\\new"] and store.read().count() == 21
    assert {r.mft_reference for r in store.read(volumes=[3]).where("name IN ('d1', 'new')").collect()} == {31, 99}
    assert store.read(base).count() == 20  # an old version reads as it was


def test_of_two_writers_the_second_fails(spark, store):
    base = store.head()
    store.upsert(files(spark, ("C:\\a", 1, 1, False)), base=base)
    with pytest.raises(Conflict):
        store.delete_volume(2, base=base)
    assert store.head().number == 2 and store.read().count() == 21
    assert not list(Path(store.where).rglob("*.draft"))


def test_deleting_a_volume_writes_no_rows(spark, store):
    before = written(store)
    store.delete_volume(2)
    assert written(store) == before and sorted(store.head().folders) == [1, 3, 4, 5] and store.read().count() == 16
    for v in (1, 3, 4, 5):
        store.delete_volume(v)
    assert store.read().count() == 0 and store.read().columns == store.schema.names
    assert CatalogStore(spark, f"{store.where}-none", store.schema).read().count() == 0


def test_rows_are_not_seen_before_they_are_published(spark, store):
    store.write(files(spark, ("C:\\z", 1, 7, False)))
    assert store.read().count() == 20


def test_exact_names_are_pushed_to_the_files(spark, store):
    plan = store.read(folded=True).where("name_lc = 'd1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name_lc,d1)" in plan
    plan = store.read(volumes=None).where("volume_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(volume_id" in plan


def test_read_change_log_by_volume(spark):
    rows = log(spark, [(1, 5, 1, 5, "a", 256, False), (1, 9, 1, 5, "b", 256, False), (2, 5, 1, 5, "c", 256, False), (3, 1, 1, 5, "d", 256, False)])
    offsets = spark.createDataFrame([(1, 5), (2, 7), (4, 40)], "volume_id long, last_usn long")
    found, after = journal.read_change_log(rows, offsets)
    assert sorted(r.name for r in found.collect()) == ["b", "d"]
    assert {tuple(r) for r in after.collect()} == {(1, 9), (2, 7), (3, 1), (4, 40)}


def test_directories_of_the_batch_count(spark):
    """A directory, one below it, and a file in that come in one batch, the file first; one is renamed, one ends nowhere."""
    rows = [(1, 1, 53, 52, "in.txt", 256, False), (1, 2, 52, 51, "deep", 256, True), (1, 3, 51, 5, "new", 256, True), (1, 4, 11, 5, "old", 0x1000, True), (1, 5, 11, 5, "renamed", 0x2000, True),
            (1, 6, 54, 11, "below.txt", 256, False), (1, 7, 61, 62, "x", 256, True), (1, 8, 62, 61, "y", 256, True), (1, 9, 63, 61, "lost", 256, False), (1, 10, 12, 5, "d2", 512, True), (1, 11, 64, 12, "orphan", 256, False), (2, 12, 65, 51, "other volume", 256, False)]
    catalog = files(spark, ("C:\\d1", 1, 11, True), ("C:\\d2", 1, 12, True), ("C:\\keep", 1, 13, False))
    after = changes.apply_changes(log(spark, rows), catalog, None, volumes(spark, 2))
    assert paths(after) == ["C:\\keep", "C:\\new", "C:\\new\\deep", "C:\\new\\deep\\in.txt", "C:\\renamed", "C:\\renamed\\below.txt"]
    assert paths(changes.apply_changes(log(spark, rows), after, None, volumes(spark, 2))) == paths(after)


def test_long_chains_of_new_directories(spark):
    rows = [(1, 200 - i, 100 + i, 99 + i if i else 5, f"n{i}", 256, True) for i in range(40)]
    after = changes.apply_changes(log(spark, rows), files(spark), None, volumes(spark, 1))
    assert max(paths(after), key=len) == "C:\\" + "\\".join(f"n{i}" for i in range(40)) and after.count() == 40


def test_modified_sizes(spark):
    batch = log(spark, [(1, 1, 11, 5, "d1", 2, False), (1, 2, 11, 5, "d1", 0x80000002, False), (1, 3, 40, 5, "made", 256, False)]).withColumn("size", F.col("usn") * 100)
    catalog = files(spark, ("C:\\d1", 1, 11, False), ("C:\\d2", 1, 12, False))
    sizes = lambda **how: {r.full_path: r.size for r in changes.apply_changes(batch, catalog, None, volumes(spark, 1), **how).collect()}
    assert sizes() == {"C:\\d1": 1, "C:\\d2": 1, "C:\\made": 300}
    assert sizes(update_modified=True) == {"C:\\d1": 200, "C:\\d2": 1, "C:\\made": 300}


def add(spark, where, rows):
    log(spark, rows).coalesce(1).write.mode("append").partitionBy("volume_id").parquet(where)


def feed(spark, where, since):
    spark.dataSource.register(journal.ChangeLog)
    return spark.readStream.format("change_log").option("since", json.dumps(since)).load(where)


def made(v, usn, ref, name, parent=5, directory=False):
    return (v, usn, ref, parent, name, 256, directory)


def run(spark, store, tmp_path, since, name="log"):
    q = changes.apply_stream(feed(spark, f"{tmp_path}/{name}", since), store, volumes(spark, 5), f"{tmp_path}/checkpoint-{store.where.rpartition('/')[2]}")
    q.awaitTermination(120)
    return q


def test_stream_resumes_each_volume_where_it_stood(spark, store, tmp_path):
    where = f"{tmp_path}/log"
    add(spark, where, [made(1, 10, 71, "old"), made(1, 20, 72, "a"), made(2, 5, 73, "b")])
    run(spark, store, tmp_path, {1: 10})
    assert store.head().offsets == {1: 20, 2: 5}
    before = written(store)
    add(spark, where, [made(2, 6, 74, "c"), made(1, 15, 75, "too late"), made(3, 1, 76, "d", 30)])
    run(spark, store, tmp_path, {1: 10})
    assert store.head().offsets == {1: 20, 2: 6, 3: 1} and all("/volume_id=2/" in p or "/volume_id=3/" in p for p in written(store) - before)
    found = set(paths(store.read()))
    assert {"C:\\a", "D:\\b", "D:\\c", "E:\\d0\\d"} <= found and not {"C:\\old", "C:\\too late"} & found
    n = store.head().number
    run(spark, store, tmp_path, {1: 10})
    assert store.head().number == n  # nothing new, no version


@pytest.mark.parametrize("stop", ["before", "after"])
def test_stopped_between_write_and_publish_or_right_after(spark, store, tmp_path, monkeypatch, stop):
    """The first try of a batch dies after its rows were written, or after it was published; the next gives what one clean pass gives."""
    clean = CatalogStore(spark, f"{tmp_path}/clean", store.schema)
    clean.replace(store.read())
    where = f"{tmp_path}/log"
    add(spark, where, [made(1, 1, 80, "dir", directory=True), made(1, 2, 81, "file", 80), made(2, 1, 82, "x"), (2, 2, 21, 5, "d1", 512, False)])
    publish = CatalogStore._publish

    def dies(self, version):
        if stop == "after":
            publish(self, version)
        raise RuntimeError("lost")

    monkeypatch.setattr(CatalogStore, "_publish", dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, store, tmp_path, {})
    monkeypatch.setattr(CatalogStore, "_publish", publish)
    assert store.head().number == (1 if stop == "before" else 2)
    run(spark, store, tmp_path, {})
    run(spark, clean, tmp_path, {})
    assert paths(store.read()) == paths(clean.read()) and store.head().offsets == clean.head().offsets == {1: 2, 2: 2}
    assert store.head().number == 2 and "C:\\dir\\file" in paths(store.read())


def test_ranges_are_planned_by_volume_and_usn(spark, tmp_path):
    where = f"{tmp_path}/log"
    add(spark, where, [made(v, u, u, "n") for v in (1, 2) for u in range(100)])
    add(spark, where, [made(1, u, u, "n") for u in range(100, 200)])
    reader = journal.ChangeLogReader(where, {"1": 50})
    assert reader.initialOffset() == {"1": 50} and reader.latestOffset() == {"1": 199, "2": 99}
    parts = reader.partitions({"1": 150}, {"1": 180, "2": 99})
    assert sorted((p.volume, p.low, p.high) for p in parts) == [(1, 150, 180), (2, -1, 99)]
    assert sorted(u for p in parts for b in reader.read(p) if p.volume == 1 for u in b.column("usn").to_pylist()) == list(range(151, 181))
    assert reader.partitions({"1": 199, "2": 99}, {"1": 199, "2": 99}) == []


def batches(spark, where, rows, schema_of, parts):
    """Writes rows as files that a stream takes one by one."""
    for n, part in enumerate(parts):
        schema_of(rows[part[0] : part[1]]).coalesce(1).write.mode("append").parquet(where)


def test_rename_stream_equals_the_batch_form(spark, tmp_path):
    random.seed(7)
    rows = [(1 + i % 2, i, 40 + random.randrange(4), 5, f"n{i}", random.choice([0x1000, 0x2000, 2, 256]), False) for i in range(120)]
    whole = log(spark, rows)
    shuffled = rows[:]
    for at in range(0, 120, 30):  # other order within what a watermark waits for
        part = shuffled[at : at + 30]
        random.shuffle(part)
        shuffled[at : at + 30] = part
    where = f"{tmp_path}/in"
    for at in range(0, 120, 15):
        log(spark, shuffled[at : at + 15]).coalesce(1).write.mode("append").parquet(where)
    log(spark, [(9, 100_000, 1, 5, "end", 256, False)]).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 2).parquet(where).withWatermark("ts", "60 seconds")
    q = changes.rename_stream(stream, 3_600_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    columns = ["volume_id", "file_reference", "usn", "to_usn", "from_name", "to_name"]
    want = {tuple(r) for r in changes.rename_pairs(whole).select(*columns).collect()}
    assert len(want) > 5 and {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()} == want


def events(spark, *rows):
    return spark.createDataFrame(rows, "path string, kind string, t long").select("path", "kind", F.timestamp_seconds("t").alias("ts"))


def test_event_dedupe_lets_its_state_go(spark, tmp_path):
    where, t = f"{tmp_path}/in", 1_700_000_000
    steps = [[("a", "modified", t), ("a", "modified", t + 1), ("b", "modified", t)], [("a", "modified", t + 5), ("c", "modified", t + 1000)], [("x", "modified", t + 1500)], [("d", "modified", t + 2000), ("a", "modified", t + 2000)], [("e", "modified", t + 2001)]]
    for s in steps:
        events(spark, *s).coalesce(1).write.mode("append").parquet(where)
    files_in_order = spark.readStream.schema(events(spark, *steps[0]).schema).option("maxFilesPerTrigger", 1).parquet(where)
    q = changes.event_dedupe(files_in_order, "10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.path, int(r.ts.timestamp()) // 100 * 100 - t) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 0), ("a", 2000), ("b", 0), ("c", 1000), ("d", 2000), ("e", 2000), ("x", 1500)]
    states = [p["stateOperators"][0] for p in map(lambda x: json.loads(x.json), q.recentProgress) if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) < 7 and sum(s["numRowsRemoved"] for s in states) >= 3
    assert changes.event_dedupe(events(spark, *sum(steps, []))).count() == 6


def test_change_rates_drop_late_changes(spark, tmp_path):
    where = f"{tmp_path}/in"
    first = [(1, 0, 1, 5, "a", 256, False), (2, 60, 1, 5, "b", 512, False), (1, 4000, 1, 5, "c", 256, False)]
    second = [(1, 3590, 2, 5, "in time", 256, False), (1, 9000, 2, 5, "d", 256, False)]
    third = [(1, 30, 3, 5, "late", 256, False), (2, 30_000, 3, 5, "end", 256, False)]
    for rows in (first, second, [(1, 9100, 5, 5, "e", 256, False)], third, [(5, 60_000, 1, 5, "after", 2, False)]):
        log(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("usn") + 1_699_999_200)).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(log(spark, first).schema).option("maxFilesPerTrigger", 1).parquet(where)
    q = changes.change_rates(stream, late="30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    found = {(int(r.window_start.timestamp()) - 1_699_999_200, r.volume_id, r.kind): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(int(r.window_start.timestamp()) - 1_699_999_200, r.volume_id, r.kind): r.n for r in changes.change_rates(spark.read.parquet(where)).collect()}
    assert found[0, 1, "created"] == 2 and batch[0, 1, "created"] == 3  # the in-time one counts, the late one only in batch
    assert {k: n for k, n in batch.items() if k in found and k != (0, 1, "created")} == {k: n for k, n in found.items() if k != (0, 1, "created")}
