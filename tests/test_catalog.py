"""Catalog queries against their SQL, and hand-made cases."""

import random
import re
import struct

import pytest
from conftest import DATA
from oracle import difference
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.functions import paths as P
from shelfmark.functions.regex import parse
from shelfmark.operators import maintain, relocate, search, stats, tree
from shelfmark.plans import catalog
from shelfmark.sources import catalog as sources
from shelfmark.sources import buckets, records
from shelfmark.streaming import changes


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert difference(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], DATA) is None


def named(spark, *names):
    return spark.createDataFrame([(n, f"C:\\d\\{n}", False, 1) for n in names], "name string, full_path string, is_directory boolean, size long")


@pytest.mark.parametrize("glob,n", [("*.txt", 2), ("report.*", 2), ("data.???", 1)])
def test_glob(spark, glob, n):
    assert search.search(named(spark, "report.txt", "report.pdf", "data.txt", "image.png"), [glob]).count() == n


def test_glob_escapes_and_live_wildcards(spark):
    files = named(spark, "file_with_underscore.txt", "file%with%percent.txt", "normal.txt")
    assert search.search(files, ["*_*"]).count() == 1 and search.search(files, ["*%*"]).count() == 1
    assert search.search(named(spark, "100%_complete.txt", "test_file.txt", "100%_done.txt"), ["100", "%"], mode="all", kind="plain").count() == 2
    assert search.search(files, ["%"], kind="plain", literal=True).count() == 1
    assert [search.glob_to_like(g) for g in ("*.txt", "file?.txt", "test%file", "test_file", "*.*", "???")] == ["%.txt", "file_.txt", "test\\%file", "test\\_file", "%.%", "___"]


def test_random_globs_equal_python(spark):
    rng, letters = random.Random(3), "ab_%.\\"
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(150)})
    files = named(spark, *names)
    for _ in range(8):
        glob = "".join(rng.choice(letters + "*?") for _ in range(rng.randint(1, 4)))
        pattern = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.DOTALL)
        assert {r[0] for r in files.where(search.matches_glob(F.col("name"), glob)).select("name").collect()} == {n for n in names if pattern.fullmatch(n)}


def test_expansion():
    assert set(search.expand_patterns(["some", "name"])) == {"some", "name", "somename", "some.name"}
    assert search.expand_patterns(["a.b c"]) == ["a.b c", "a b c", "ab c"]
    assert search.expand_patterns(["a.b"]) == ["a.b", "a b", "ab"] and search.expand_patterns(["*.x", " "]) == ["*.x"]


@pytest.mark.parametrize("pattern", ["(", ")", "a(?=b)", "(?<!a)b", r"a\1", r"\Z", "[[:nope:]]", "*a", "a{2", "[b-a]", "(?-u)a", "(?P<x>a)(?P<x>b)", "[]", r"\q", "(?i)*"])
def test_regex_is_checked_first(pattern):
    with pytest.raises(ValueError):
        search.matches_regex(F.col("name"), pattern)


#: Patterns, a text each that they find, and one that they don't; case counts.
REGEXES = [
    (r"^\p{L}+$", "éa", "é1"), (r"\pN", "x٣", "x"), (r"(?P<x>a)b", "ab", "b"), ("[[:alpha:]]", "1a", "1é"), ("[[:^digit:]]", "1a", "12"), (r"a\\1", "a\\1", "a1"), ("a$", "ba", "a\n"), ("(?m)a$", "a\nb", "ab"),
    ("[a-z--[aeiou]]", "eb", "e"), (r"^[\w&&[^\d]]+$", "ab", "a5"), ("^[a-c~~[b-d]]$", "d", "b"), ("^a{2}{2}$", "aaaa", "aa"), ("^a++$", "aaa", "b"), (r"\x{e9}", "é", "e"), (r"\u00e9\x41", "éA", "éa"), ("^.$", "\r", "\n"),
    ("(?s)^.$", "\n", "ab"), ("(?x) a b # c", "ab", "a b"), ("(?i)É", "é", "e"), ("a(?i:B)c", "abc", "abC"), ("(?i)a(?-i)b", "Ab", "AB"), ("[]a]", "]", "b"), ("[^]a]", "b", "]a"), ("[a-]", "-", "b"), (r"\bred\b", "a red b", "reds"),
    (r"\b{start}red", "red", "ared"), (r"^\p{Greek}\P{Greek}$", "αa", "aα"), (r"\p{Lowercase_Letter}", "Aa", "A"), (r"^\d\s\w$", "٣ é", "٣é"), ("x|y(?:z|w)", "yw", "y"), (r"[\[\]#\- ]", "#", "a"), ("^a{,2}$", "aa", "aaa"), (r"\.\+\$", ".+$", "a+$"),
]


def test_regexes(spark):
    rows = spark.createDataFrame([(i, text, found) for i, (_, yes, no) in enumerate(REGEXES) for text, found in ((yes, True), (no, False))], "i int, name string, found boolean")
    for i, (pattern, yes, no) in enumerate(REGEXES):
        got = {r.name: r.m for r in rows.where(F.col("i") == i).select("name", search.matches_regex(F.col("name"), pattern, True).alias("m")).collect()}
        assert got == {yes: True, no: False}, pattern


def test_listing_of_no_folder_and_exclusions_of_stars(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_listing(spark, str(tmp_path / "gone"))
    (tmp_path / "a").mkdir()
    for pattern in ("*", "**", "*a", "a*", "*a*", "/a", "b"):
        files = spark.createDataFrame([(f"{tmp_path}/a",)], "full_path string")
        listed = sources.read_listing(spark, str(tmp_path), (pattern,)).count() == 2
        assert listed == (files.where(~search.excluded(F.col("full_path"), [pattern])).count() == 1), pattern


def test_columns(spark):
    row = spark.range(1).select(*(P.format_size(F.lit(n)).alias(f"s{n}") for n in (0, 512, 1024, 1048576, 1073741824)), *(P.file_stem(F.lit(n)).alias(n.replace(".", "_")) for n in ("a.tar.gz", ".gitignore")), P.volume_key(F.lit("c:\\x")).alias("k1"), P.volume_key(F.lit("\\\\server\\share\\f")).alias("k2"), P.volume_key(F.lit("/Volumes/USB/x")).alias("k3"), P.volume_key(F.lit("x")).alias("k4"), P.volume_prefix(F.lit("\\\\?\\D:\\data")).alias("p1"), P.volume_prefix(F.lit("x/y")).alias("p2")).first()
    assert tuple(row) == ("0 B", "512 B", "1.00 KB", "1.00 MB", "1.00 GB", "a.tar", ".gitignore", "C:", "\\\\server\\share", "/Volumes/USB", "UNKNOWN", "d:", None)


def drives(spark, **letters):
    return spark.createDataFrame([(i, m, "ntfs") for m, i in letters.items()], "id long, mount_point string, volume_type string").withColumn("mount_point", F.concat("mount_point", F.lit(":")))


def test_tree_orphan_empty_name_and_cycle(spark):
    rows = [(50, 5, "Projects", True), (60, 50, "rust", True), (500, 60, "main.rs", False), (100, 999, "orphan.txt", False), (30, 5, "", True), (101, 30, "file.txt", False), (70, 71, "a", True), (71, 70, "b", True)]
    records = spark.createDataFrame([(*r, 30) for r in rows], "file_reference long, parent_reference long, name string, is_directory boolean, volume_id long")
    found = {r.mft_reference: r.full_path for r in tree.resolve_paths(records, drives(spark, E=30)).collect()}
    assert found[500] == "E:\\Projects\\rust\\main.rs" and found[100] == "E:\\orphan.txt" and found[101] == "E:\\file.txt"


def test_references_are_told_per_volume(spark):
    rows = [(3, 30, 1, 0x200, "a", 5), (4, 30, 2, 0x100, "b", 5), (3, 40, 3, 0x1000, "old", 5), (4, 40, 4, 0x2000, "other", 5), (3, 40, 5, 0x2000, "new", 5)]
    log = spark.createDataFrame([(*r, False) for r in rows], "volume_id long, file_reference long, usn long, reason long, name string, parent_reference long, is_directory boolean")
    assert {(r.volume_id, r.file_reference, r.usn) for r in changes.fold_changes(log).collect()} == {(3, 30, 1), (4, 30, 2), (3, 40, 5), (4, 40, 4)}
    assert [(r.volume_id, r.from_name, r.to_name) for r in changes.rename_pairs(log).collect()] == [(3, "old", "new")]
    assert {tuple(r) for r in changes.stale_references(log, spark.createDataFrame([(3, 0)], "volume_id long, last_usn long")).collect()} == {(3, 30), (3, 40)}
    old = spark.createDataFrame([("C:\\a", 3, 30, "a", False, 1, None), ("D:\\a", 4, 30, "a", False, 1, None)], "full_path string, volume_id long, mft_reference long, name string, is_directory boolean, size long, created_time timestamp")
    nowhere = spark.createDataFrame([], "volume_id long, ref long, path string")
    after = changes.apply_changes(log, old, nowhere, drives(spark, C=3, D=4))
    assert {(r.full_path, r.volume_id) for r in after.collect()} == {("D:\\b", 4), ("C:\\new", 3), ("D:\\other", 4)}


def test_subtree_keeps_siblings(spark):
    files = spark.createDataFrame([(p,) for p in ("C:\\Test", "C:\\Test\\file.txt", "C:\\Testing", "C:\\Testing\\file.txt", "C:\\TestData")], "full_path string")
    assert maintain.delete_subtree(files, "C:/Test").count() == 3


def test_prune_leaves_offline_volumes(spark):
    files = spark.createDataFrame([("C:\\a", 1, 1, False), ("D:\\b", 2, 2, False)], "full_path string, volume_id long, mft_reference long, is_directory boolean")
    listing = spark.createDataFrame([("C:\\z", False)], "full_path string, is_directory boolean")
    assert [r.full_path for r in maintain.prune(files, listing)[0].collect()] == ["D:\\b"]
    assert maintain.prune(files, listing, force=True)[0].count() == 0


def test_prune_by_id_and_below_missing(spark):
    rows = [("C:\\d", 1, 1, True), ("C:\\d\\x", 1, 2, False), ("C:\\d\\new", 1, 9, False), ("C:\\k", 1, 3, False)]
    files = spark.createDataFrame(rows, "full_path string, volume_id long, mft_reference long, is_directory boolean")
    listing = spark.createDataFrame([("C:\\k", False), ("C:\\d\\x", False)], "full_path string, is_directory boolean")
    kept, removed = maintain.prune(files, listing, max_id=5)
    assert {r.full_path for r in kept.collect()} == {"C:\\k", "C:\\d\\new"} and {r.full_path for r in removed.collect()} == {"C:\\d", "C:\\d\\x"}
    assert tuple(maintain.prune_stats(maintain.flag_missing(files, listing)).first()) == ("C:", 4, 2, 1, 2)


def test_many_saved_searches(spark):
    files = named(spark, "Report.txt", "ring", "a", "")
    asked = spark.createDataFrame([(1, "RING"), (2, "g"), (3, ""), (4, "po"), (5, "nothing"), (6, None), (7, "rt.t")], "query_id long, pattern string")
    found = {(r.query_id, r.name) for r in search.multi_query_search(files, asked).collect()}
    assert found == {(1, "ring"), (2, "ring"), (3, "Report.txt"), (3, "ring"), (3, "a"), (3, ""), (4, "Report.txt"), (7, "Report.txt")}


def test_saved_searches_of_every_kind(spark):
    """Equal to one search after another, whatever grams the patterns have."""
    names = ["Report.txt", "report_2.TXT", "ring", "KRing", "\u212aring", "Stra\u00dfe.log", "a", "", "boot.log", "BOOTS.LOG.1", "app-12.log", "x%y_z", "ma\u017fk", "\u0130ndex", "aXb", "axxb", "ab", "line\nend", "\u00c4rger.txt", "\u00e4rger.TXT"]
    files = named(spark, *names)
    regexes = ["kring", "mask", "index", "report|ring|boot", "^(?:re|bo)\\w+", r"a(x+)b", r"a(x?)b", r"[.]log(\.\d)?$", r"\p{Lu}", "(?i)BOOT", "(?x) r i n g", "", ".", "a{2,}", "(boots|)", "\u00e4rger", r"(?P<n>app)-[[:digit:]]+", "x[%]y", "line.end", r"line\nend", "(ring){1}", "(rep)+o"]
    asked = [(p, "regex") for p in regexes] + [(p, "glob") for p in ("*.txt", "?", "*o*.log*", "*", "", "x%*", "*ss*", "RING")] + [(p, "plain") for p in ("ring", "x%y", "", "G", ".LOG", "\u00c4r", "nothing")]
    asked += [("Ring", "exact"), ("", "exact"), ("*.log", "auto"), ("log", "auto"), ("ring", None), (None, "regex"), ("ring", "plain")]
    table = spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(asked)], "query_id long, pattern string, kind string")
    for case_sensitive in (False, True):
        got = sorted((r.query_id, r.name) for r in search.multi_query_search(files, table, case_sensitive).collect())
        wanted = sorted((i, r.name) for i, (p, k) in enumerate(asked) if p is not None for r in search.search(files, [p], kind=k or "plain", case_sensitive=case_sensitive, literal=True).collect())
        assert got == wanted
    bad = spark.createDataFrame([(1, "(a", "regex")], "query_id long, pattern string, kind string")
    with pytest.raises(Exception, match="expected"):
        search.multi_query_search(files, bad)
    assert search.multi_query_search(files, table.limit(0)).count() == search.multi_query_search(files.limit(0), table).count() == 0


@pytest.mark.parametrize("pattern, needs", [("abc.def", [{"abc"}, {"def"}]), ("(ab|cd)E+", [{"ab", "cd"}, {"e"}]), ("a*b?", []), ("(a|b*)c", [{"c"}]), (r"x\.y$", [{"x.y"}]), ("(abc|x(de)?fgh)", [{"abc", "fgh"}]), ("[ab]c", [{"c"}]), ("(?:ab){0,2}c", [{"c"}])])
def test_texts_that_an_expression_needs(pattern, needs):
    assert [set(x) for x in parse(pattern)[1]] == needs


def test_grouped_report_begins_with_matched_directories(spark):
    row = lambda p, d: (p, p.rsplit("\\", 1)[1], d, 1)
    schema = "full_path string, name string, is_directory boolean, size long"
    found = [row("C:\\m", True), row("C:\\gone", True), row("C:\\bare", True), row("C:\\other", True), row("C:\\m\\1", False), row("C:\\m\\2", False), row("C:\\m\\3", False), row("C:\\m\\s\\4", False), row("C:\\gone\\5", False), row("C:\\gone\\6", False)]
    there = [row("C:\\m", True), row("C:\\bare", True), row("C:\\other", True), row("C:\\other\\x", False)]
    result, listing = spark.createDataFrame(found, schema), spark.createDataFrame(there, schema)
    assert [tuple(r) for r in stats.report_grouped(result, listing, 2).collect()] == [
        (True, "C:\\bare", "empty", 0, None, None, None),
        (True, "C:\\gone", "missing", 2, None, None, None),
        (True, "C:\\m", "files", 4, "C:\\m\\1", 1, 1),
        (True, "C:\\m", "files", 4, "C:\\m\\2", 2, 1),
        (True, "C:\\other", "no_match", 0, None, None, None),
        (False, "C:\\m\\s", "files", None, "C:\\m\\s\\4", 1, 0),
    ]
    assert stats.report_grouped(result.limit(0), listing).count() == 0


def test_a_small_delta_leaves_the_catalog_where_it_is(spark):
    schema = "full_path string, size long, mft_reference long"
    old = spark.createDataFrame([(f"C:\\{i}", i, i) for i in range(50)] + [(None, 7, 7)], schema)
    delta = spark.createDataFrame([("C:\\3", 30, 99), ("C:\\4", None, None), ("D:\\new", 1, 2), (None, 8, 8)], schema)
    ways = [maintain.upsert(old, delta, "full_path", ("mft_reference",), small) for small in (False, True)]
    assert len({tuple(sorted(map(str, w.collect()))) for w in ways}) == 1 and ways[1].count() == 53
    assert maintain.upsert(old, delta.limit(0), "full_path", small=True).count() == 51 and maintain.upsert(old.limit(0), delta, "full_path", small=True).count() == 4
    assert maintain.is_small(delta) and not maintain.is_small(old, 1000) and maintain.is_small(old.limit(0), 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stale = spark.createDataFrame([(3,)], "mft_reference long")
        assert "Exchange hashpartitioning" not in maintain.delete_keys(old, stale, "mft_reference", small=True)._jdf.queryExecution().executedPlan().toString()
        whole, halves = (maintain.upsert(old, delta, "full_path", small=small)._jdf.queryExecution().executedPlan().toString() for small in (False, True))
        assert "FullOuter" in whole and "FullOuter" not in halves and "LeftOuter, BuildRight" in halves
        dealt = halves.split("LeftOuter, BuildRight")[1].split("SortMergeJoin")[0]  # from the old rows to the new ones
        assert "Exchange hashpartitioning" not in dealt and "BroadcastExchange" in dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def record(version, ref, parent, usn, reason, attributes, name, pad=0):
    wide, text = version == 3, name.encode("utf-16-le")
    n = (76 if wide else 60) + len(text) + pad
    refs = struct.pack("<Q8xQ8x" if wide else "<QQ", ref, parent)
    return struct.pack("<IHH", n, version, 0) + refs + struct.pack("<qqIIIIHH", usn, 0, reason, 0, 0, attributes, len(text), 76 if wide else 60) + text + b"\0" * pad


def test_record_buffers(spark):
    high = 9 << 48
    one = struct.pack("<q", 77) + record(2, high | 30, 5, 1, 0x80000100, 0x10, "dir", 4) + record(3, 31, high | 30, 2, 2, 0x20, "é€😀.txt") + record(4, 1, 1, 1, 1, 1, "no version") + record(2, 5, 5, 3, 1, 0, "")
    bad = bytearray(record(2, 32, 5, 4, 1, 0, "x"))
    bad[56:58] = struct.pack("<H", 900)
    two = struct.pack("<q", 78) + bytes(bad) + record(2, 33, 5, 5, 1, 0, "kept") + b"\0\0\0\0" + record(2, 34, 5, 6, 1, 0, "behind a zero")
    long_ = struct.pack("<q", 79) + struct.pack("<I", 4000) + b"\0" * 80
    table = spark.createDataFrame([(x,) for x in (one, two, long_, b"short", b"", None)], "buffer binary")
    found = {tuple(r) for r in records.decode_record_buffers(table).collect()}
    assert found == {(77, 1, 30, 5, "dir", 0x80000100, 16, True), (77, 2, 31, 30, "é€😀.txt", 2, 32, False), (77, 3, 5, 5, "", 1, 0, False), (78, 5, 33, 5, "kept", 1, 0, False)}
    assert {r.name for r in records.decode_record_buffers(table, snapshot=True).collect()} == {"dir", "é€😀.txt", "kept"}


def test_listing_of_empty_excluded_and_hidden_folders(spark, tmp_path):
    for name in ("empty", "a/b", "skip/below", ".git", ".tmpdir"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("a/b/one.txt", "skip/below/two.txt", ".git/three", ".tmpdir/four", "a/five.log"):
        (tmp_path / name).write_text("12345")
    found = sources.read_listing(spark, str(tmp_path), ("*skip", "*.log")).collect()
    paths = [r.full_path.removeprefix(str(tmp_path)) for r in found]
    assert paths == ["", "/.tmpdir", "/.tmpdir/four", "/a", "/a/b", "/a/b/one.txt", "/empty"]
    assert [r.size for r in found] == [0, 0, 5, 0, 0, 5, 0] and found[0].is_directory and found[0].name == tmp_path.name
    state = {r.directory: r.state for r in stats.directory_state(spark.createDataFrame([(f"{tmp_path}/empty",), (f"{tmp_path}/gone",), (f"{tmp_path}/a/b",)], "full_path string"), spark.createDataFrame(found)).collect()}
    assert state == {f"{tmp_path}/empty": "empty", f"{tmp_path}/gone": "missing", f"{tmp_path}/a/b": "has_files"}


def test_user_views_stay(spark):
    spark.range(7).createOrReplaceTempView("orders")
    sources.derive(spark, DATA, "changes").count()
    assert spark.table("orders").count() == 7
    spark.catalog.dropTempView("orders")


def test_debounce_holds_one_window(spark):
    rows = [("p", 0, 1, "created"), ("p", 5, 2, "modified"), ("p", 10, 3, "deleted"), ("q", 3, 4, "modified"), (None, 1, 5, "created")]
    events = spark.createDataFrame(rows, "path string, t long, seq long, kind string").select("path", F.timestamp_seconds("t").alias("ts"), "seq", "kind")
    got = {(r.path, r.first_ts.timestamp(), r.kind, r.n) for r in changes.debounce_events(events, 10).collect()}
    assert got == {("p", 0.0, "created", 2), ("p", 10.0, "deleted", 1), ("q", 3.0, "modified", 1), (None, 1.0, "created", 1)}
    assert changes.debounce_events(events.limit(0), 10).count() == 0


def test_move_plan(spark):
    files = spark.createDataFrame([(f"C:\\{p}", p.split("\\")[1], False, 1) for p in ("dest\\file1", "source1\\file2", "source2\\file2", "other\\file3")], "full_path string, name string, is_directory boolean, size long")
    plan = relocate.move_plan(files, "C:\\dest", spark.createDataFrame([], "name string"))
    assert {r.disposition: r.n for r in relocate.move_plan_summary(plan).collect()} == {"move": 2, "in_destination": 1, "duplicate": 1}


def test_duplicates(spark):
    files = named(spark, ".gitignore", ".GitIgnore", "archive.tar.gz", "archive.tar.bz2", "Makefile", "makefile", "one.txt")
    assert {r.stem for r in stats.duplicate_stems(files).collect()} == {".gitignore", "archive.tar", "makefile"}


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(f"p{i % 3}", 1_700_000_000 + i * 7, i, ("created", "modified", "deleted")[i % 3]) for i in range(40)]
    events = spark.createDataFrame(rows, "path string, t long, seq long, kind string").select("path", F.timestamp_seconds("t").alias("ts"), "seq", "kind")
    later = spark.createDataFrame([("end", 1_800_000_000, 99, "created")], "path string, t long, seq long, kind string").select("path", F.timestamp_seconds("t").alias("ts"), "seq", "kind")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    later.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    q = changes.debounce_stream(stream, 60_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("path <> 'end'").collect()}
    assert got == {tuple(r) for r in changes.debounce_events(events, 60).select("path", "first_ts", "kind", "n").collect()}


def test_a_bucketed_catalog_merges_where_it_lies(spark):
    schema = "volume_id int, mft_reference long, full_path string, name string, size long"
    rows = [(i % 3, i % 40, f"C:\\d{i % 5}\\{i}", str(i), i) for i in range(90)] + [(1, None, "C:\\none", "none", 1), (None, 4, "C:\\lost", "lost", 2)]
    delta = [(0, 70, "C:\\d0\\0", "0", 100), (2, None, "C:\\d1\\1", "1", None), (0, 3, "C:\\new", "new", 7), (1, 1, "C:\\d4\\4", "4", 8)]
    frame = lambda x: spark.createDataFrame(x, schema)
    stale = spark.createDataFrame([(0, 3), (1, 4), (1, 4), (2, None), (7, 7)], "volume_id int, mft_reference long")
    told = lambda df: sorted(map(str, df.collect()))
    referred = lambda df: told(df.where("volume_id IS NOT NULL AND mft_reference IS NOT NULL").select("volume_id", "mft_reference", "full_path"))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", had):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            catalog = buckets.BucketedCatalog.written(frame(rows), 5)
            assert told(catalog.rows()) == told(frame(rows)) and told(catalog.references()) == referred(frame(rows))
            after = catalog.merged(frame(delta), stale=stale)
            want = maintain.apply_snapshot(frame(rows), frame(delta), stale)
            assert told(after.rows()) == told(want) and told(after.references()) == referred(want)
            again = after.merged(frame([]), ("mft_reference",)).merged(frame(delta[:1]), ("size",), stale=stale.limit(0))
            assert told(again.rows()) == told(maintain.upsert(want, frame(delta[:1]), "full_path", ("size",))) and again.buckets == 5
            assert told(again.references()) == referred(again.rows())
            there = buckets.BucketedCatalog.opened(spark, again.where, again.schema, again.buckets)
            assert told(there.rows()) == told(again.rows())
            empty = buckets.BucketedCatalog.written(frame([]))
            assert empty.rows().count() == 0 and told(empty.merged(frame(delta)).rows()) == told(frame(delta))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    with pytest.raises(Exception, match="no path"):
        buckets.BucketedCatalog.written(frame([(1, 1, None, "x", 1)]), 2)


def _shuffled_scans(plan: str) -> list[str]:
    """The scans of a formatted tree that an exchange of rows by key is above of, told by indentation."""
    above, found = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "FileScan" in line and any("Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x for _, x in above):
            found.append(line)
    return found


def test_a_bucketed_catalog_is_not_shuffled(spark):
    schema = "volume_id int, mft_reference long, full_path string, name string, size long"
    catalog = buckets.BucketedCatalog.written(spark.createDataFrame([(1, i, f"C:\\{i}", str(i), i) for i in range(50)], schema), 4)
    delta, stale = catalog.rows().sparkSession.createDataFrame([(1, 3, "C:\\3", "3", 4)], schema), spark.createDataFrame([(1, 5)], "volume_id int, mft_reference long")
    plain = spark.createDataFrame([(1, i, f"C:\\{i}", str(i), i) for i in range(50)], schema)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merge, purge, paths = plan(catalog.upserted(delta)), plan(catalog.without(stale)), plan(catalog.stale_paths(stale))
        assert "FullOuter" in merge and "FileScan" in merge and not _shuffled_scans(merge)
        assert "Exchange hashpartitioning" in plan(maintain.upsert(plain, delta, "full_path")).split("FullOuter")[1].split("ExistingRDD")[0]
        # What references give, the paths of the stale ones, moves; the references themselves and the rows do not.
        assert "LeftAnti" in purge and not [x for x in _shuffled_scans(purge) if "size" in x]
        below = paths.split("LeftSemi")[1].split("FileScan")[0]
        assert "Exchange" not in below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_derived_tables_follow_the_given_ones(spark, tmp_path):
    for name in sources.TABLES:
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    count = lambda: sources.derive(spark, str(tmp_path), "mft").count()
    before, asked = count(), set(re.findall(r"\{(\w+)\}", sources.VIEWS["mft"]))
    assert before > 0 and count() == before
    for name in asked & set(sources.TABLES):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    assert count() == 0


def test_a_delta_of_every_volume_is_written(spark):
    files = sources.derive(spark, DATA, "files").where("mft_reference % 5 = 0")
    written = catalog.queries()["write_catalog"](spark, DATA).where("full_path LIKE '%.new'")
    counted = lambda df: {tuple(r) for r in df.groupBy("volume_id").count().collect()}
    assert len(counted(files)) == 5 and counted(written) == counted(files)


def test_highlighted_places(spark):
    """Against a plain program: overlaps, places that touch, letters that expressions and replacements read otherwise, all cases."""

    def plain(name, patterns, before, after):
        low, on = [c.lower() for c in name], [False] * len(name)
        for p in ([c.lower() for c in p] for p in patterns if p):
            for at in range(len(name) - len(p) + 1):
                if low[at : at + len(p)] == p:
                    on[at : at + len(p)] = [True] * len(p)
        return "".join((before if on[i] and not (i and on[i - 1]) else "") + c + (after if on[i] and not on[i + 1 : i + 2] == [True] else "") for i, c in enumerate(name))

    r = random.Random(3)
    names = ["", None, "RED ringring", "xABABAx", "a$b\\c[d]", "\U0001f600ÉKΣςİı\nſ", "ab" * 20_000, *("".join(r.choice("abAB.$\\\nÉé") for _ in range(r.randrange(12))) for _ in range(300))]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(names)], "n int, name string").repartition(2)
    for patterns, before, after in ((["ring", "red"], "[", "]"), (["aba", "bb", ""], "$1", "\\"), ([".$", "\\", "É\n", "[d"], "<b>", "</b>"), (["kσ", "İ", "\U0001f600"], "[", "]"), ([""], "[", "]")):
        found = {x.n: x.v for x in rows.select("n", P.highlight_name(F.col("name"), patterns, before, after).alias("v")).collect()}
        assert found == {n: None if x is None else plain(x, patterns, before, after) for n, x in enumerate(names)}


def test_highlighting_asks_no_function_for_each_letter(spark):
    names = spark.createDataFrame([("RED ring",)], "name string").select(P.highlight_name(F.col("name"), ["ring", "red"]).alias("v"))
    assert names.first()[0] == "[RED] [ring]" and "lambda" not in names._jdf.queryExecution().optimizedPlan().toString()


def test_parents_are_told_once(spark):
    """The entries of a scan against the view's own text: parents that are files, lack a name, a parent or a row, are their own or given twice."""
    rows = [(24, 5, "N", True), (25, 5, None, True), (1000, 24, "c", True), (1001, 25, "d", True), (1001, 24, "e", True), (1002, 999, "f", True), (1003, 1003, "g", True)]
    rows += [(10_000 + n, up, f"x{n}", False) for n, up in enumerate((1000, 1001, 1002, 1003, 24, 25, 5, None, 10_000, 777))]
    mft = spark.createDataFrame([(*r, 1, None, 1 + r[0] % 3) for r in rows], "file_reference long, parent_reference long, name string, is_directory boolean, size long, created_time timestamp, volume_id long")
    told, as_said = spark.sql(sources._BESIDE["scan_entries"], mft=mft), spark.sql(sources.VIEWS["scan_entries"], mft=mft)
    assert told.schema == as_said.schema and sorted(map(str, told.collect())) == sorted(map(str, as_said.collect()))
    assert told.count() == len(rows) + 1


def test_rows_are_not_sorted_to_be_written_by_volume(spark, tmp_path):
    had, seen = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"), []
    rows = spark.range(100).select("id", (F.col("id") % 40).alias("volume_id"))
    session.write_by_volume(rows, f"{tmp_path}/rows")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rows").collect())) == [(n, n % 40) for n in range(100)]
    for how in (lambda: session.write_by_volume(rows, f"{tmp_path}/a"), lambda: rows.write.partitionBy("volume_id").parquet(f"{tmp_path}/b")):
        how()
        store = spark._jsparkSession.sharedState().statusStore()
        seen.append("Sort" in store.executionsList().last().physicalPlanDescription())
    assert seen == [False, True] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == had


def test_every_directory_is_sorted_by_size(spark, tmp_path):
    """As many directories as have sizes, and those of equal size by path: in the second folder every file has size 1."""
    for name in ("nation", "customer", "orders"):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        (rows.withColumn("o_totalprice", F.lit(1.0)) if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    for where in (DATA, str(tmp_path)):
        sizes, found = ([tuple(r) for r in catalog.queries()[n](spark, where).collect()] for n in ("directory_sizes", "sort_directories_by_size"))
        assert len(found) > 100 and found == sorted(sizes, key=lambda r: (-r[1], r[0]))
    assert len({size for _, size in found}) < len(found)
