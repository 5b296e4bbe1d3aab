"""Exact order statistics against brute force, with one group holding most rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import experiments as ex, ranking, service_logs as sl


def brute(rows):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return {k: statistics.median(v) for k, v in groups.items()}


@pytest.fixture(params=[4096, 3])
def slices(request, monkeypatch):
    """Also with slices so wide that they hold many values."""
    monkeypatch.setattr(ranking, "SLICES", request.param)


ROWS = (
    [("hot", float((i * 7919) % 10007) / 7 - 300) for i in range(3000)]
    + [("flat", 4.25)] * 500
    + [("two", 1.0), ("two", 2.0), ("one", -0.5), ("none", None), (None, 3.0), (None, 5.0), (None, 4.0)]
    + [("tiny", 1e-9 * i) for i in range(101)]
    + [("huge", 1e12 + i) for i in range(200)]
)


def test_medians(spark, slices):
    df = spark.createDataFrame(ROWS, "k string, v double").repartition(5)
    got = {r["k"]: r["median"] for r in ranking.exact_medians(df, ["k"], "v").collect()}
    assert got == brute(ROWS)


def test_any_rank(spark, slices):
    df = spark.createDataFrame(ROWS, "k string, v double").filter("k = 'hot'")
    ranks = {"first": "1", "third": "3", "last": "size", "beyond": "size + 1", "none": "NULL"}
    got = {r["pick"]: r["value"] for r in ranking.exact_picks(df, ["k"], "v", ranks).collect()}
    values = sorted(v for k, v in ROWS if k == "hot")
    assert got == {"first": values[0], "third": values[2], "last": values[-1]}


def test_without_keys(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("v"))
    assert ranking.exact_picks(df, [], "v", {"p": "250"}).first()["value"] == 250


def test_nan_is_the_largest_value(spark):
    rows = [("k", v) for v in (-5.0, 1.0, float("nan"))] + [("i", v) for v in (float("-inf"), 2.0, float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r["k"]: r["median"] for r in ranking.exact_medians(df, ["k"], "v").collect()} == {"k": 1.0, "i": 2.0}


def test_nothing_runs_before_the_caller_asks(spark):
    df = spark.createDataFrame([r for r in ROWS if r[1] is not None], "k string, v double").withColumn("s", F.lit(False))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    ranking.exact_medians(df, ["k"], "v")
    ex.median_by(df, ["k"], ["v"])
    ex.rank_configs(df, [], ["k"], "v", "s")
    sl.summarise(df.select(*[F.lit(1).alias(c) for c in ("mode", "instance", "pid", "rows", "inflight", "us_per_row", "cpu_us_per_row", "cpu_share")]), ["mode"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_no_keys_is_no_cross_join(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("v"))
    plan = ranking.exact_picks(df, [], "v", {"p": "250"})._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ties_in_a_third_of_the_rows(spark):
    rows = [("g", 5.0, f"name{i:04d}") for i in range(1000)] + [("g", float(i), None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double, t string").repartition(4)
    got = sorted((r["rank"], r["v"], r["t"] or "") for r in ranking.ranked(df, ["k"], "v", ["t"]).collect())
    want = sorted(((-v, t or "") for _, v, t in rows))
    assert [(-v, t) for _, v, t in got] == want and [r for r, *_ in got] == list(range(1, 3001))


def test_ranks_number_every_row_once(spark):
    df = spark.createDataFrame([r for r in ROWS if r[1] is not None], "k string, v double").withColumn("t", F.monotonically_increasing_id())
    got = ranking.ranked(df, ["k"], "v", ["t"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["k"], []).append((r["rank"], -r["v"], r["t"]))
    for members in groups.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1:] for m in members] == sorted(m[1:] for m in members)


def test_cells_rise_with_the_value(spark):
    values = [-1e300, -5.0, -1e-3, 0.0, 1e-12, 0.1, 0.2, 1.0, 1.0000001, 3e7, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = [r[0] for r in df.orderBy("v").select(ranking.cell(F.col("v"))).collect()]
    assert cells == sorted(cells)
