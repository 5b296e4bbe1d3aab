"""Log and measurement operators against brute force and published vectors."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import errors, experiments as ex, service_logs as sl
from cloakframe.sources.logs import parse_lines, scan_log

START = dt.datetime(2024, 1, 1)


def swept(spans):
    """Peak, area and window by walking all edges; ends before starts."""
    edges = sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans])
    live = peak = area = 0
    at = edges[0][0]
    for t, step in edges:
        area += live * (t - at)
        at, live = t, live + step
        peak = max(peak, live)
    window = edges[-1][0] - edges[0][0]
    return peak, (area / window if window else 0.0), window / 1e6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_concurrency(spark, seed):
    rnd = random.Random(seed)
    rows, spans = [], {}
    for i in range(400):
        key = rnd.choice(["a", "a", "b", None])
        end = rnd.choice([rnd.randrange(0, 5_000_000), rnd.randrange(0, 4) * 1_000_000, rnd.randrange(0, 9 * 3_600_000_000)])
        ms = rnd.choice([0.0, 0.5, 1000.0, rnd.randrange(0, 7_200_000) / 1.0])
        rows.append((key, START + dt.timedelta(microseconds=end), ms))
        spans.setdefault(key, []).append((end - round(ms * 1000), end))
    df = spark.createDataFrame(rows, "k string, ts timestamp, total_ms double")
    for r in sl.concurrency(df, ["k"]).collect():
        peak, mean, window = swept(spans[r["k"]])
        assert r["concurrency_peak"] == peak
        assert math.isclose(r["concurrency_mean"], mean, rel_tol=1e-12)
        assert math.isclose(r["busy_window_s"], window, rel_tol=1e-12)


def test_lines_without_duration_take_no_part(spark):
    df = spark.createDataFrame([("a", START, None), ("a", START, 5.0)], "k string, ts timestamp, total_ms double")
    assert sl.concurrency(df, ["k"]).first()["concurrency_peak"] == 1


def test_windows_are_inclusive_and_may_overlap(spark):
    hour = dt.timedelta(hours=1)
    logs = spark.createDataFrame([(i, START + i * hour) for i in range(10)], "i int, ts timestamp")
    windows = spark.createDataFrame(
        [("w1", START, START + 3 * hour), ("w2", START + 3 * hour, START + 30 * hour)], "w string, start timestamp, `end` timestamp"
    )
    got = sorted((r["w"], r["i"]) for r in sl.assign_windows(logs, windows).collect())
    assert got == [("w1", i) for i in range(4)] + [("w2", i) for i in range(3, 10)]
    wide = sl.padded(windows, 3600)
    assert sl.assign_windows(logs, wide).count() == 5 + 8


def test_p95_takes_the_sorted_value_at_95_percent(spark):
    for n in (20, 21, 40, 100):
        rows = [("k", "i", 1, 1, 1, float(i), 1.0, 0.5) for i in range(1, n + 1)]
        df = spark.createDataFrame(rows, "k string, instance string, pid int, rows int, inflight int, us_per_row double, cpu_us_per_row double, cpu_share double")
        expected = sorted(float(i) for i in range(1, n + 1))[int(n * 0.95)] if n > 20 else None
        assert sl.summarise(df, ["k"]).first()["us_per_row_p95"] == expected


def test_scan_drops_what_cannot_be_read(spark):
    lines = [
        '{"timestamp": "2024-01-01T00:00:00Z", "service": "s", "jsonPayload": {"event": "batch", "rows": 1}}',
        '{"receiveTimestamp": "2024-01-01T00:00:01Z", "service": "s", "jsonPayload": {"event": "batch", "rows": 2}}',
        '{"timestamp": "nonsense", "receiveTimestamp": "2024-01-01T00:00:01Z", "service": "s", "jsonPayload": {"event": "batch"}}',
        '{"timestamp": "2024-01-01T00:00:00Z", "service": "s"}',
        '{"timestamp": "2024-01-01T00:00:00Z", "service": "t", "jsonPayload": {"event": "batch"}}',
        '{"timestamp": "2024-01-01T00:00:00Z", "service": "s", "jsonPayload": {"event": "other"}}',
        "no json",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert sorted(r["payload"]["rows"] for r in scan_log(parse_lines(df), "s").collect()) == [1, 2]


CALIBRATION = [(1, 1.90), (2, 3.20), (4, 5.40), (8, 9.80), (16, 19.00), (32, 36.80), (64, 70.70), (128, 137.70), (256, 269.10), (512, 584.20)]


def test_calibration_fit(spark):
    rows = [("c", f"cpu_r{x}_b5000", y + d) for x, y in CALIBRATION for d in (-0.5, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, function string, us double").withColumn("x", ex.rounds_of("function"))
    fit = ex.theil_sen(ex.calibration_curve(df, ["k"], "function", "x", "us"), ["k"]).first()
    assert round(fit["slope"], 4) == 1.0879 and round(fit["floor"], 2) == 1.09
    assert fit["worst_x"] == 512 and fit["points"] == 8


def test_fit_keeps_functions_of_equal_rounds_apart(spark):
    rows = [("c", "cpu_r10_b0", 1.0), ("c", "cpu_r10_b1", 9.0), ("c", "cpu_r20_b0", 21.0)]
    df = spark.createDataFrame(rows, "k string, function string, us double").withColumn("x", ex.rounds_of("function"))
    fit = ex.theil_sen(ex.calibration_curve(df, ["k"], "function", "x", "us"), ["k"]).first()
    assert fit["points"] == 3 and fit["slope"] == (2.0 + 1.2) / 2


def test_means_at_any_magnitude(spark):
    df = spark.createDataFrame([("a", 1e-5), ("a", 3e-5), ("b", 1e15), ("b", 3e15)], "k string, v double")
    assert {r["k"]: r["mean"] for r in ex.mean_by(df, ["k"], "v").collect()} == {"a": pytest.approx(2e-5), "b": 2e15}


def test_names_without_rounds_have_none(spark):
    df = spark.createDataFrame([("cpu_r128_b5000",), ("noop_b5000",), (None,), ("cpu_r1234567890_b1",)], "f string")
    assert [r[0] for r in df.select(ex.rounds_of("f")).collect()] == [128, None, None, 1234567890]


def measured(spark, rows):
    return spark.createDataFrame(rows, "phase string, config string, rps double, sentinel boolean")


def test_drift_vector(spark):
    first = [("scale", "w5", v, False) for v in (3614.0, 4722.0, 4886.0)]
    again = [("scale", "w5", v, True) for v in (4894.0, 4934.0, 4960.0)]
    stable = [("rule", "w7", v, s) for v, s in ((5149.0, False), (5452.0, False), (5340.0, True), (5450.0, True))]
    once = [("alone", "w1", 1.0, False), ("old", "w1", 1.0, None)]
    got = {r["phase"]: r["drifted"] for r in ex.drift(measured(spark, first + again + stable + once), ["phase", "config"]).collect()}
    assert got == {"scale": True, "rule": False}


def test_ranking_verdicts(spark):
    runs = {"2": (11721, 11784, 11903), "1": (11572, 11657, 11803), "8": (11543, 11644, 11736), "4": (9607, 11564, 11575)}
    rows = [("p", c, float(v), False) for c, values in runs.items() for v in values] + [("p", "4", 99999.0, True)]
    ranking = ex.rank_configs(measured(spark, rows), ["phase"], ["config"])
    got = {r["config"]: (r["rank"], r["verdict"]) for r in ranking.collect()}
    assert got == {"2": (1, "best"), "1": (2, "indistinguishable"), "8": (3, "indistinguishable"), "4": (4, "slower")}
    overall = {r["config"]: r["rank"] for r in ex.rank_configs(measured(spark, rows), [], ["config"]).collect()}
    assert overall == {c: r for c, (r, _) in got.items()}


def test_error_messages(spark):
    cases = {
        "Protect failed. Invalid email address": "44, The content of the input data is not valid.",
        "Unprotect failed. 169.254.17.189:The content of the input data is not valid.": "44, The content of the input data is not valid.",
        "The content of the input data is not valid.": "44, The content of the input data is not valid.",
        "Invalid email address, domain length > 254": "23, Data is too long to be protected/unprotected.",
        "Something else": "Something else",
        "": "",
    }
    df = spark.createDataFrame([(m,) for m in [*cases, None]], "m string")
    got = {r["m"]: r["n"] for r in df.select("m", errors.normalise("m").alias("n")).collect()}
    assert got == {**cases, None: None}


def test_pending_cells_ignore_sentinels(spark):
    plan = spark.createDataFrame([("p", "a", "f"), ("p", "b", "f"), ("p", None, "f")], "phase string, config string, function string")
    rows = [("p", "a", "f", False)] * 3 + [("p", "b", "f", False)] * 2 + [("p", "b", "f", True)] + [("p", None, "f", None)] * 3
    done = spark.createDataFrame(rows, "phase string, config string, function string, sentinel boolean")
    assert [r["config"] for r in ex.pending_cells(plan, done, 3).collect()] == ["b"]


def test_burst_hour_is_dealt_out_evenly(spark):
    """Nine tenths of the lines in one hour: no join task holds more than twice the median, one row a match."""
    hour = F.lit("2024-01-05 10:00:00").cast("timestamp")
    logs = spark.range(40_000).select(
        "id", (hour + F.make_dt_interval(hours=F.when(F.col("id") % 10 == 0, F.col("id") % 24).otherwise(F.lit(0)).cast("int"), mins=(F.col("id") % 59).cast("int"))).alias("ts")
    )
    windows = spark.createDataFrame([("a", 0, 48), ("b", 0, 1), ("c", 5, 7)], "variant string, f int, t int").select(
        "variant", (hour + F.make_dt_interval(hours=F.col("f"))).alias("start"), (hour + F.make_dt_interval(hours=F.col("t"))).alias("end")
    )
    plain = logs.crossJoin(windows).where("ts >= start AND ts <= end").groupBy("variant").count().collect()
    hits = sl.assign_windows(logs, windows, lines_a_share=1000)
    assert sorted(map(tuple, hits.groupBy("variant").count().collect())) == sorted(map(tuple, plain))
    line = F.xxhash64("id", "ts")
    shares = logs.where(F.date_trunc("hour", "ts") == hour).groupBy(F.pmod(line, F.lit(38))).count().agg(F.max("count"), F.median("count")).first()
    assert shares[0] <= 2 * shares[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        held = sl.assign_windows(logs, windows, lines_a_share=500).where("variant = 'a'").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert held.sum() == 40_000 and held.max() <= 2 * held.median()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_variant_records_keep_unknown_fields(spark, tmp_path):
    from cloakframe.sources.tables import field, scan_variant_lines

    (tmp_path / "a.jsonl").write_text('{"phase": "a", "x": {"deep": [1, 2]}}\n\n  \n{"phase": 7}\n{broken\n[3]\n')
    rows = scan_variant_lines(spark, str(tmp_path), broken="keep")
    told = rows.select(field("record", "phase", "string").alias("p"), field("record", "x.deep[1]", "int").alias("d"), "broken_line").collect()
    assert sorted(map(tuple, told), key=repr) == sorted([("a", 2, None), ("7", None, None), (None, None, "{broken"), (None, None, None)], key=repr)
    with pytest.raises(Exception, match="MALFORMED|parse"):
        scan_variant_lines(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="broken must be"):
        scan_variant_lines(spark, str(tmp_path), broken="maybe")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_read_once(spark):
    """Filters on the envelope, on the payload and on the time do not parse the line or the time again."""
    rows = [('{"timestamp": "2024-01-01T00:00:05Z", "service": "s", "jsonPayload": {"event": "batch", "rows": 1}}',), ("no json",), (None,), ("{}",), ("",)]
    lines = spark.createDataFrame(rows, "value string")
    parsed = parse_lines(lines)
    assert [(r.service, r.jsonPayload and r.jsonPayload.rows) for r in parsed.collect()] == [("s", 1)] + [(None, None)] * 4
    scanned = scan_log(parsed, "s", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", ordered=True)
    assert scanned.select("payload.rows").collect() == [(1,)]
    assert _plan(scanned).count("from_json(") == 1 and _plan(scanned).lower().count("cast(coalesce(") + _plan(scanned).count("try_to_timestamp(") + _plan(scanned).count("gettimestamp(") <= 1


def test_rounds_are_looked_for_once(spark):
    """The pattern stands once in a plan, and medians read stored measurements."""
    rows = [("a", f"cpu_r{4 + i}_b1", float(i + 1)) for i in range(5)] + [("a", "none", 1.0)]
    df = spark.createDataFrame(rows, "k string, function string, us double").withColumn("x", ex.rounds_of("function"))
    assert _plan(df).count("cpu_r(") == 1
    curve = ex.calibration_curve(df, ["k"], "function", "x", "us")
    assert "cpu_r(" not in _plan(curve)
    assert sorted((r.x, r.y) for r in curve.collect()) == [(4 + i, float(i + 1)) for i in range(5)]
