"""Rendezvous sharding and curriculum mixing against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from cloakframe.llm import mixing, sharding
from cloakframe.llm.queries import QUERIES


def plan_text(df):
    return df._jdf.queryExecution().toString()


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5_whole_table(spark, folder, documents):
    df = QUERIES["op5_sharding"](spark, folder)
    rows, texts = df.collect(), {d: t for d, t, _ in documents}
    assert len(rows) == len(documents) and "Python" not in plan_text(df)
    check_slots(rows)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, brute.crc(texts[r.doc_id]))


def test_growing_moves_only_into_the_new_shard(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    moved = sharding.assign(sharding.assign(keys, shards=40), shards=41, into="grown").where("shard <> grown")
    rows = moved.collect()
    assert all(r.grown == 40 for r in rows) and 300 < len(rows) < 700  # about one in 41


def test_weights_set_the_shares(spark):
    got = sharding.assign(spark.range(40_000), key="id", shards=3, weights=(1.0, 2.0, 5.0)).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 40_000 for r in got}
    assert share == pytest.approx({0: 1 / 8, 1: 2 / 8, 2: 5 / 8}, abs=0.01)
    with pytest.raises(ValueError):
        sharding.rendezvous("id", 2, (1.0,))


def test_op5_odd_and_empty(odd, none):
    rows = sharding.shard_slots(odd).collect()
    assert len(rows) == odd.count()
    check_slots(rows)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(16, 0)}
    assert sharding.shard_slots(none).count() == 0


def check_mix(rows, sources):
    """rows: doc_id, size, source_size, target, taken; sources: source of each row."""
    sizes, targets, taken = Counter(), {}, Counter()
    for r, source in zip(rows, sources):
        sizes[source] += r.size
        targets[source] = r.target
        taken[source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute.mix_targets(sizes, mixing.WEIGHTS)
    for source in sizes:
        assert targets[source] == pytest.approx(want[source], rel=1e-12)
        assert taken[source] == int(targets[source])


def test_op4_whole_table(spark, folder, documents):
    df = QUERIES["op4_mixing"](spark, folder)
    source = {d: s for d, _, s in documents}
    rows = df.collect()
    assert "Python" not in plan_text(df) and len(rows) == len(documents)
    check_mix(rows, [source[r.doc_id] for r in rows])
    assert rows == df.collect()
    sizes = {d: len(brute.words(t)) for d, t, _ in documents}
    assert all(r.size == sizes[r.doc_id] for r in rows)


def test_op4_odd_and_empty(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count()
    check_mix(rows, [r.source for r in rows])
    assert mixing.mix_plan(none).count() == 0 and mixing.mixed(none).count() == 0


def test_all_sources_full_or_empty(spark):
    one = spark.createDataFrame([(1, "a b c d", "x")], "doc_id long, text string, source string")
    assert mixing.mix_plan(one).first().taken == 6
    blank = spark.createDataFrame([(1, "", "x"), (2, None, "y")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0]


def test_stream_holds_what_the_plan_takes(spark, odd):
    words = lambda rows: Counter({k: v for k, v in rows})
    plan, taken = mixing.mix_plan(odd).collect(), Counter()
    for r in plan:
        taken[r.doc_id] += r.taken
    stream, got = mixing.mixed(odd), Counter()
    assert stream.columns == odd.columns
    for r in stream.collect():
        got[r.doc_id] += len(brute.words(r.text))
    assert words((k, v) for k, v in taken.items() if v) == got


def test_inverted_demand_follows_the_schedule(spark):
    """Between two positions the demand is the integral of the weights."""
    knots = mixing.SCHEDULES[1]
    shares = spark.range(101).select((F.col("id") / 100).alias("u"))
    rows = shares.select("u", mixing.invert_demand(F.col("u"), knots).alias("t")).collect()

    def served(t, steps=4000):
        total = 0.0
        for i in range(steps):
            x = t * (i + 0.5) / steps
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                if t0 <= x < t1:
                    total += (w0 + (w1 - w0) * (x - t0) / (t1 - t0)) * t / steps
        return total

    whole = served(1.0)
    for r in rows:
        assert served(r.t) / whole == pytest.approx(r.u, abs=1e-3)
    assert mixing.SCHEDULES[0] and [r.t for r in rows] == sorted(r.t for r in rows)
