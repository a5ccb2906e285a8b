"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source's documents, in the order of a hash of their id, form blocks of `block` documents. With weight w its j-th block
is released at slot floor((j-1)/w) and due by slot ceil(j/w). One block goes into each slot: of the released ones, that with
the earliest deadline. As the weights sum to one this meets all deadlines, so after any number of slots each source is less
than one block from its share. Weights are whole numbers out of `period`, which is so large that over a whole corpus of 2^26
blocks rounding is less than a thirtieth of a block; nothing repeats. The schedule is cut into stretches of `STRETCH` blocks,
which tasks fold apart and which are made to meet (`schedule`).

When a source has no more blocks its slots stay empty and the others keep their proportions; every document is placed, none
is dropped or repeated. A null source is a source of its own. A source without a positive target weight gets the smallest
weight, 1 of `period`. Repeated rows are placed each, in any order among themselves; rows without an id are spread by their
other columns; deadlines that tie go to the source that sorts first. An empty table gives an empty result. A document's
other columns are kept as they are, whatever their names, but for those of the mixture's own five, which are replaced.

The counts table has a row per source; its size is that of the list of sources, not of the documents. Positions within a
source are counted in buckets of the hash, so that no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK, PERIOD = 16, 1 << 31
#: Blocks that one part of the fold schedules; an array of this size is copied for each.
PART = 256
#: Blocks of a stretch, about; slots that a stretch begins early; stretches of one task.
STRETCH, WARM, EACH = 1024, 64, 4
#: Documents that one bucket of a source holds, about; a bucket is what one task sorts at once.
BUCKET = 1000


def shares(counts: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, period: int = PERIOD) -> DataFrame:
    """Adds `share`, a source's weight in whole numbers: by the given target weights, or the counts to a power.

    Largest remainders fill the period; each source has 1 at least.
    """
    wish = F.pow(F.col("n").cast("double"), F.lit(power))
    if weights is not None:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.lit(None).cast("map<string,double>")
        wish = F.greatest(F.coalesce(F.try_element_at(given, F.col("source")).cast("double"), F.lit(0.0)), F.lit(0.0))
    every = Window.partitionBy(F.lit(0))  # one row per source
    rows = counts.withColumn("wish", wish).withColumn("all", F.sum("wish").over(every))
    rows = rows.withColumn("exact", F.when(F.col("all") > 0, F.col("wish") / F.col("all") * period).otherwise(F.lit(0.0)))
    rows = rows.withColumn("left", F.when(F.col("all") > 0, F.lit(period)).otherwise(0) - F.sum(F.floor("exact")).over(every))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.floor("exact")), F.col("source"))
    return rows.withColumn("share", F.greatest(F.floor("exact") + (F.row_number().over(by_rest) <= F.col("left")).cast("int"), F.lit(1)).cast("long")).drop("wish", "all", "exact", "left")


def stretches(shared: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """t0, t1: the slots from 0 to the last source's end, cut where about `stretch` blocks more are due by then.

    Between the ends of two sources, which are rows in order of their end, blocks come at an even rate."""
    period = F.sum("share").over(Window.partitionBy(F.lit(0)))
    rows = shared.select("source", "share", F.ceil(F.col("n") / block).cast("long").alias("blocks"), period.alias("period")).where("blocks > 0")
    by_end = Window.partitionBy(F.lit(0)).orderBy("b", "source")
    rows = rows.withColumn("b", _end(F.col("blocks"), F.col("share"), F.col("period"))).withColumn("a", F.lag("b", 1, 0).over(by_end))
    past = F.coalesce(F.sum("share").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("rate", (F.col("period") - past) / F.col("period")).withColumn("due", F.sum((F.col("b") - F.col("a")) * F.col("rate")).over(by_end.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("had", F.coalesce(F.lag("due").over(by_end), F.lit(0.0)))
    rows = rows.withColumn("k", F.ceil(F.col("had") / stretch)).withColumn("last", F.ceil(F.col("due") / stretch) - 1)
    at = lambda k: F.col("a") + F.floor((k * stretch - F.col("had")) / F.col("rate")).cast("long")
    first = F.first(F.when(F.col("k") <= F.col("last"), at(F.col("k"))), ignorenulls=True).over(by_end.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", F.coalesce(first, F.max("b").over(Window.partitionBy(F.lit(0))))).where("k <= last")
    cut = F.transform(F.sequence("k", "last"), lambda k: F.struct(at(k).alias("t0"), F.when(k < F.col("last"), at(k + 1)).otherwise(F.col("next")).alias("t1")))
    return rows.select(F.explode(cut).alias("x")).select("x.t0", "x.t1")


def _end(blocks: Column, share: Column, period: Column) -> Column:
    """The slot by which a source's last block is due."""
    return F.call_function("div", blocks * period + share - 1, share)


def _bind(value: Column, use) -> Column:
    """What `use` makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _head(i: Column, j: Column, share: Column, blocks: Column) -> Column:
    release = F.call_function("div", j * F.col("period"), share)
    return F.struct(release.alias("release"), _end(j + 1, share, F.col("period")).alias("due"), i.alias("i"), j.alias("j"), share.alias("share"), blocks.alias("blocks"))


_ENTRY = "array<struct<i:int,j:bigint,slot:bigint>>"


def _fold(heads: Column, slot: Column, stop: Column, most: Column) -> Column:
    """heads, parts: the blocks that earliest deadline first places from `slot` up to `stop`, `most` at most, and the heads then.
    A step takes the block that wins the next slot with a released one; slots before the first release stay empty."""

    def step(had: Column, _: Column) -> Column:
        def place(slot: Column) -> Column:
            ready = F.transform(F.filter(had["heads"], lambda x: x["release"] <= slot), lambda x: F.struct(x["due"].alias("due"), x["i"].alias("i"), x["j"].alias("j")))
            placed = lambda won: F.struct(
                (slot + 1).alias("slot"),
                F.filter(F.transform(had["heads"], lambda x: F.when(x["i"] == won["i"], _head(x["i"], x["j"] + 1, x["share"], x["blocks"])).otherwise(x)), lambda x: x["j"] < x["blocks"]).alias("heads"),
                F.concat(had["part"], F.array(F.struct(won["i"].alias("i"), won["j"].alias("j"), slot.alias("slot")))).alias("part"),
            )
            return F.when(slot >= stop, had).otherwise(_bind(F.array_min(ready), placed))

        slot = F.greatest(had["slot"], F.array_min(F.transform(had["heads"], lambda x: x["release"])))
        return F.when((F.size(had["heads"]) == 0) | (had["slot"] >= stop), had).otherwise(_bind(slot, place))

    def part(had: Column, _: Column) -> Column:
        start = F.struct(had["slot"].alias("slot"), had["heads"].alias("heads"), F.array().cast(_ENTRY).alias("part"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(PART)), start, step)
        return _bind(done, lambda x: F.struct(x["slot"].alias("slot"), x["heads"].alias("heads"), F.concat(had["parts"], F.array(x["part"])).alias("parts")))

    start = F.struct(slot.alias("slot"), heads.alias("heads"), F.array().cast(f"array<{_ENTRY}>").alias("parts"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.ceil(most / PART) + 1), start, part)


def _guessed(at: Column) -> Column:
    """Heads at a slot, as they are likely to be: as many blocks placed as slots, of those that may be either the ones due first;
    once a source has ended, all that is released."""
    least = lambda x: F.when(at >= x["end"], x["blocks"]).otherwise(F.least(x["blocks"], F.call_function("div", at * x["share"], F.col("period"))))
    most = lambda x: F.when(at >= x["end"], x["blocks"]).otherwise(F.least(x["blocks"], F.call_function("div", at * x["share"] + F.col("period") - 1, F.col("period"))))
    rows = F.transform("s", lambda x, i: F.struct(_end(least(x) + 1, x["share"], F.col("period")).alias("due"), i.alias("i"), least(x).alias("least"), most(x).alias("most"), x["share"].alias("share"), x["blocks"].alias("blocks"), (at >= x["end"]).alias("over")))

    def heads(rows: Column) -> Column:
        more = at - F.aggregate(rows, F.lit(0).cast("long"), lambda had, x: had + x["least"])
        either = F.array_sort(F.transform(F.filter(rows, lambda x: x["most"] > x["least"]), lambda x: F.struct(x["due"].alias("due"), x["i"].alias("i"))))
        return _bind(F.struct(F.exists(rows, lambda x: x["over"]).alias("over"), F.get(either, (more - 1).cast("int")).alias("mark")), lambda told: F.filter(F.transform(rows, lambda x: _head(
            x["i"], F.when(told["over"] | F.coalesce(F.struct(x["due"].alias("due"), x["i"].alias("i")) <= told["mark"], F.lit(False)), x["most"]).otherwise(x["least"]), x["share"], x["blocks"])), lambda x: x["j"] < x["blocks"]))

    return _bind(rows, heads)


def _placed(heads: Column) -> Column:
    """What tells a state: the next block of each unfinished source."""
    return F.transform(heads, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j")))


def schedule(shared: DataFrame, block: int = BLOCK, stretch: int = STRETCH, warm: int = WARM) -> DataFrame:
    """source, j (from 0), slot of every block of the sources (source, n, share).

    Stretches of slots are folded side by side. Each begins `warm` slots early from a guess of what has been placed by then; as
    deadlines leave little choice it mostly has come to the one true state when its own slots begin. Those whose beginning is
    not the end of the stretch before are folded again from that end, until none is left, so the result is that of one fold
    over all blocks, whatever the guesses."""
    ordered = shared.where("n > 0").withColumn("i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")) - 1).cast("int")).withColumn("period", F.sum("share").over(Window.partitionBy(F.lit(0))))
    blocks = F.ceil(F.col("n") / block).cast("long")
    ordered = stored(ordered.select("i", "source", "share", blocks.alias("blocks"), "period", _end(blocks, F.col("share"), F.col("period")).alias("end")), "ordered")
    listed = stored(ordered.groupBy(F.lit(0).alias("one")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "share", "blocks", "end"))), lambda x: F.struct(x["share"].alias("share"), x["blocks"].alias("blocks"), x["end"].alias("end"))).alias("s"), F.max("period").alias("period")), "listed")
    cuts = stored(stretches(shared, block, stretch).withColumn("one", F.lit(0)), "cuts")
    tasks = max(1, -(-cuts.count() // EACH))
    # The list of sources meets every stretch by one stored key: Spark sends it to all tasks below its size limit only.
    known = lambda rows: rows.join(listed, "one").repartition(tasks, "t0")
    due = F.aggregate("s", F.lit(0).cast("long"), lambda had, x: had + F.when(F.col("t0") >= x["end"], 0).otherwise(F.least(x["blocks"], (F.least(F.col("t1"), x["end"]) - F.col("t0")).cast("double") * x["share"] / F.col("period") + 2).cast("long")))
    folded = lambda heads: F.struct(_placed(heads).alias("begin"), _fold(heads, F.col("t0"), F.col("t1"), due).alias("x"))
    told = lambda rows: rows.select("t0", "t1", "f.begin", _placed(F.col("f.x.heads")).alias("end"), F.col("f.x.parts").alias("parts"))
    early = F.greatest(F.col("t0") - warm, F.lit(0).cast("long"))
    begun = _fold(_guessed(early), early, F.col("t0"), F.lit(warm))["heads"]
    done = stored(told(known(cuts).select("t0", "t1", _bind(begun, folded).alias("f"))), "stretches")
    while True:
        ends = done.select(F.col("t1").alias("t0"), F.col("end").alias("reached"))
        wrong = stored(done.select("t0", "t1", "begin").join(ends, "t0").where("begin <> reached").select("t0", "t1", "reached", F.lit(0).alias("one")), "wrong")
        if wrong.isEmpty():
            break
        again = F.transform("reached", lambda x: _bind(F.get("s", x["i"]), lambda own: _head(x["i"], x["j"], own["share"], own["blocks"])))
        mended = told(known(wrong).select("t0", "t1", _bind(again, folded).alias("f")))
        done = stored(done.join(wrong.select("t0"), "t0", "left_anti").select(*mended.columns).unionByName(mended), "stretches")
    each = done.select(F.explode("parts").alias("part")).select(F.explode("part").alias("x")).select("x.i", "x.j", "x.slot")
    return each.join(ordered.select("i", "source"), "i").select("source", "j", "slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, bucket: int = BUCKET) -> DataFrame:
    """Every document with its place in the mixture: mix_block (from 1, within its source), mix_release, mix_deadline,
    mix_slot and mix_position. Ordering by mix_position interleaves the sources. The columns doc_id and source are read."""
    spread = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    hash_ = F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(*spread)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source"), hash_.alias("hash"))
    counts = stored(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sources")
    shared = stored(shares(counts, weights, period=period), "shares")
    slots = stored(schedule(shared, block), "slots")
    most = counts.agg(F.max("n")).first()[0] or 0
    width = max(1, -(-most // bucket))
    rows = rows.withColumn("bucket", F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * width).cast("long"))
    sizes = stored(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.floor(F.col("before") / block))
    # Each bucket with the slots of its blocks, some bucket / block of them.
    asked = offsets.withColumn("j", F.explode(F.sequence("first", F.floor((F.col("before") + F.col("n") - 1) / block)))).alias("a")
    slots = slots.alias("s")
    met = asked.join(slots, F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.j") == F.col("s.j")))
    met = met.groupBy("a.source", "bucket", "before", "first").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    # One row per source or bucket of some ten thousand documents: the list is small, and is sent to all tasks below its size limit only.
    plan = shared.select("source", "share", F.sum("share").over(Window.partitionBy(F.lit(0))).alias("period")).alias("p")
    met = met.alias("m").join(plan, F.col("m.source").eqNullSafe(F.col("p.source"))).select(F.struct("m.source").alias("key"), "m.bucket", "before", "first", "slots", "share", "period")
    # Ranks and the join ask for the same keys, a null source among them, so rows move once.
    rows = rows.withColumn("key", F.struct("source")).withColumn("rank", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("hash", "doc_id")))
    placed = rows.select("row", "key", "bucket", "rank").join(stored(met, "offsets"), ["key", "bucket"])
    n = F.col("before") + F.col("rank") - 1
    j = F.floor(n / block)
    slot = F.element_at("slots", (j - F.col("first") + 1).cast("int"))
    release = F.call_function("div", j * F.col("period"), F.col("share"))
    deadline = F.call_function("div", (j + 1) * F.col("period") + F.col("share") - 1, F.col("share"))
    made = {"mix_block": j + 1, "mix_release": release, "mix_deadline": deadline, "mix_slot": slot, "mix_position": slot * block + n % block}
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), *(v.alias(c) for c, v in made.items()))
