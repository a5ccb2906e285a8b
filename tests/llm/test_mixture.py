"""The mixture keeps to the target weights themselves, however many sources and slots, and up to the pipeline's result."""

import heapq
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import mixing


def _deviation(rows, target):
    """The most that a source with blocks left is from its target, in blocks, after any slot."""
    had, worst, last = dict.fromkeys(target, 0), 0.0, {}
    for r in rows:
        last[r.source] = max(last.get(r.source, 0), r.mix_slot)
    for r in sorted(rows, key=lambda r: r.mix_slot):
        worst = max([worst, *(abs(had[s] - w * r.mix_slot) for s, w in target.items() if r.mix_slot <= last[s])])
        had[r.source] += 1
    return worst


def test_target_weights_over_many_slots(spark):
    n = {f"s{i}": 80 for i in range(19)} | {"hot": 2400}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, source string")
    all_ = sum(k**0.5 for k in n.values())
    assert _deviation(mixing.mix(docs, block=1).collect(), {s: k**0.5 / all_ for s, k in n.items()}) < 1


def test_more_sources_than_a_thousand(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("source"))
    weights = {"hot": 1200.0 * 0.9 / 0.1} | {f"s{i}": 1.0 for i in range(300, 1500)}
    first = mixing.mix(docs, weights, block=1).where("mix_slot < 200").groupBy("source").count().where("source = 'hot'").first()[1]
    assert abs(first - 0.9 * 200) < 1


def _one_fold(share, blocks):
    """Slot of each block (source, j), by one run over all slots with two heaps."""
    period, j, slot, slots = sum(share), [0] * len(share), 0, {}
    coming, ready = [(0, i) for i, n in enumerate(blocks) if n], []
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            _, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j[i] + 1) * period // share[i]), i))
        _, i = heapq.heappop(ready)
        slots[i, j[i]] = slot
        j[i] += 1
        if j[i] < blocks[i]:
            heapq.heappush(coming, (j[i] * period // share[i], i))
        slot += 1
    return slots


@pytest.mark.parametrize("sources, most, stretch, warm", [(1, 300, 32, 8), (4, 200, 32, 0), (7, 120, 16, 4), (40, 30, 64, 16), (600, 4, 128, 16)])
def test_stretches_meet_as_one_fold(spark, sources, most, stretch, warm):
    r = random.Random(sources)
    counts = spark.createDataFrame([(f"s{i:04}", r.choice([1, 15, 17, *(16 * r.randint(1, most) for _ in range(5))]) if i else 16 * most) for i in range(sources)], "source string, n long")
    shared = mixing.shares(counts)
    rows = sorted(shared.collect())
    found = mixing.schedule(shared, 16, stretch, warm).collect()
    assert {(int(x.source[1:]), x.j): x.slot for x in found} == _one_fold([x.share for x in rows], [-(-x.n // 16) for x in rows])
    cuts = sorted(mixing.stretches(shared, 16, stretch).collect())
    assert cuts[0].t0 == 0 and all(a.t0 < a.t1 == b.t0 for a, b in zip(cuts, cuts[1:])) and (sources == 1 or len(cuts) > 1)


def test_pipeline_tells_the_place(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = corpus_pipeline.run(spark, DATA)
    place = {r.doc_id: r.mix_position for r in found.collect()}
    assert len(set(place.values())) == len(place)
    rows = [(r.source, place[r.doc_id] // mixing.BLOCK) for r in docs.collect() if r.doc_id in place]
    count = {s: sum(x == s for x, _ in rows) for s, _ in rows}
    all_ = sum(k**0.5 for k in count.values())
    for slot in range(1, 1 + max(b for _, b in rows)):
        for s, k in count.items():
            blocks = {b for x, b in rows if x == s}
            if slot <= max(blocks):
                assert abs(len({b for b in blocks if b < slot}) - slot * k**0.5 / all_) < 1
