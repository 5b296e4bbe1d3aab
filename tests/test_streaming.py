"""Streams: nothing twice, late rows out, same result as a batch."""

import datetime as dt

from pyspark.sql import functions as F

from cloakframe.functions.detect import TextConfig
from cloakframe.operators.text import redact
from cloakframe.operators.tokens import tokenize_table
from cloakframe.sources.pii import PII_SCHEMA, mock_pii
from cloakframe.streaming import live

START = dt.datetime(2024, 1, 1)


def test_tokens_in_several_runs_equal_the_batch(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    people = mock_pii(spark, 300)
    for part in range(3):
        people.filter(F.col("id") % 3 == part).write.mode("append").parquet(source)
        stream = live.tokenize_stream(live.read_table_stream(spark, source, PII_SCHEMA, files_per_batch=1))
        live.append_to(stream, sink, state).awaitTermination()
    live.append_to(stream, sink, state).awaitTermination()  # nothing new, nothing twice
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert got == sorted(map(tuple, tokenize_table(people).collect()))


def test_redacted_stream_equals_the_batch(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = spark.createDataFrame([(i, f"mail a{i}@b.com now") for i in range(20)], "doc long, text string")
    docs.write.parquet(source)
    config = TextConfig(labels={"EMAIL_ADDRESS": "EMAIL"})
    live.append_to(live.redact_stream(live.read_table_stream(spark, source, docs.schema), "text", config), sink, state).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(
        map(tuple, docs.withColumn("text", redact("text", config)).collect())
    )


def test_late_rows_are_dropped(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, mode string, rows long"

    def feed(*hours):
        rows = [(START + dt.timedelta(hours=h), "m", 10) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = live.read_table_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        live.append_to(live.live_summary(stream, ["mode"]), sink, state).awaitTermination()

    feed(0.1, 0.2, 1.5)
    feed(5.0)  # the watermark passes hours 0 and 1
    feed(0.3, 9.0)  # the first of these is too late
    got = sorted((r["window_start"].hour, r["log_batches"], r["log_rows_total"]) for r in spark.read.parquet(sink).collect())
    assert got == [(0, 2, 20), (1, 1, 10), (5, 1, 10)]


def feed_lines(spark, source, rows, columns="ts timestamp, mode string, total_ms double"):
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
    return live.read_table_stream(spark, source, spark.createDataFrame([], columns).schema, files_per_batch=1)


def levels(spans, begin, end):
    """(peak, mean) between two moments of intervals in seconds, by a plain sweep."""
    steps = sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans])
    live_now = sum(s for t, s in steps if t < begin)
    peak, area, at = live_now, 0.0, begin
    for t, step in steps:
        if begin <= t < end:
            area, at, live_now = area + live_now * (t - at), t, live_now + step
            peak = max(peak, live_now)
    return peak, (area + live_now * (end - at)) / (end - begin)


def test_live_concurrency_over_several_runs(spark, tmp_path):
    """Closed hours equal a sweep over all lines, though starts come long after later ends; late lines are dropped."""
    import random

    pick, source, sink, state = random.Random(6), *(str(tmp_path / n) for n in ("in", "out", "state"))
    lines = sorted((round(pick.uniform(0, 6 * 3600), 3), pick.choice("ab"), round(pick.uniform(0, 2400), 3)) for _ in range(400))
    freak = (lines[250][0], "a", 20_000.0)  # longer than the longest, counts as an hour
    parts = [lines[i : i + 100] for i in range(0, 400, 100)]
    parts[2] = [*parts[2], freak, (10.0, "a", 5.0)]  # the second of these is hours late
    for part in [*parts, [(12 * 3600.0, "z", 1.0)], [(13 * 3600.0, "z", 1.0)]]:
        stream = feed_lines(spark, source, [(START + dt.timedelta(seconds=t), m, d * 1000) for t, m, d in part])
        live.append_to(live.live_cells(stream, ["mode"], cell_seconds=300), sink, state).awaitTermination()
    got = {(r["mode"], (r["window_start"] - START).total_seconds()): (r["concurrency_peak"], r["concurrency_mean"])
           for r in live.concurrency_by_window(spark.read.parquet(sink), ["mode"]).collect()}
    for mode in "ab":
        spans = [(t - min(d, 3600), t) for t, m, d in [*lines, freak] if m == mode]
        for hour in range(-1, 6):
            begin = hour * 3600.0
            if any(begin <= t < begin + 3600 for span in spans for t in span):
                peak, mean = levels(spans, begin, begin + 3600)
                assert got[mode, begin][0] == peak and abs(got[mode, begin][1] - mean) < 1e-6


def test_sketches_merge_across_windows(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    columns = "ts timestamp, mode string, instance string, cost double"
    rows = [(START + dt.timedelta(seconds=i), "m", f"i{i % 7}" if i % 3 else "", float(i) if i % 5 else None) for i in range(20_000)]
    rows += [(START, "few", None, 1.0)] * 20 + [(START, "none", "x", None)] + [(START + dt.timedelta(days=1), "end", "x", 1.0)]
    stream = feed_lines(spark, source, rows, columns)
    live.append_to(live.live_sketches(stream, ["mode"], ["cost"]), sink, state).awaitTermination()
    windows = spark.read.parquet(sink)
    assert windows.filter("mode = 'm'").count() == 6
    told = {r["mode"]: r for r in live.merged_sketches(windows, ["mode"], ["cost"]).collect()}
    assert told["m"]["log_batches"] == 20_000 and told["m"]["instances"] == 7
    assert abs(told["m"]["cost_median"] - 10_000) < 200 and abs(told["m"]["cost_p95"] - 19_000) < 200
    assert told["few"]["cost_median"] == 1.0 and told["few"]["cost_p95"] is None and told["few"]["instances"] == 0
    assert told["none"]["cost_median"] is None and "end" not in told
