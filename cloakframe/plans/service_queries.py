"""Queries on a service log, which the events table stands in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors, service_logs as sl
from ..session import spread
from ..sources.logs import parse_lines, payloads, scan_log
from ..sources.tables import table
from .base import query

# one event is one batch: value is its duration in minutes, k its rows
_LOG = """log AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'batch_error' ELSE 'batch' END AS event,
    CASE WHEN user_id % 10 = 9 THEN NULL ELSE 'i' || (user_id % 5) END AS instance, user_id AS pid, event_type AS mode,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS rows, user_id % 4 + 1 AS inflight,
    value * 60000 AS total_ms, value * 48000 AS work_ms, value * 480 * (event_id % 101) AS cpu_ms,
    (ARRAY[400, 408, 429, 500, 503, 504])[CAST(event_id % 6 AS INTEGER) + 1] AS status FROM events),
  costs AS (SELECT *, work_ms * 1000 / greatest(rows, 1) AS us_per_row, cpu_ms * 1000 / greatest(rows, 1) AS cpu_us_per_row,
    CASE WHEN work_ms > 0 THEN cpu_ms / work_ms END AS cpu_share FROM log)"""


def service_log(spark, folder):
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        "event_id", "ts",
        F.when(F.col("event_type") == "error", "batch_error").otherwise("batch").alias("event"),
        F.when(user % 10 != 9, F.concat(F.lit("i"), user % 5)).alias("instance"),
        user.alias("pid"), F.col("event_type").alias("mode"),
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("rows"), (user % 4 + 1).alias("inflight"),
        (F.col("value") * 60000).alias("total_ms"), (F.col("value") * 48000).alias("work_ms"),
        (F.col("value") * 480 * (F.col("event_id") % 101)).alias("cpu_ms"),
        F.get(F.array(*[F.lit(s) for s in (400, 408, 429, 500, 503, 504)]), (F.col("event_id") % 6).cast("int")).alias("status"),
    )


def _median_sql(value: str) -> str:
    return f"""(list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))[(count({value}) + 1) // 2]
        + list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))[count({value}) // 2 + 1]) / 2.0"""


def _summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS log_batches, CAST(sum(rows) AS BIGINT) AS log_rows_total,
      CAST(sum(rows) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS batch_rows_mean, max(rows) AS batch_rows_max,
      count(DISTINCT instance) AS instances, count(DISTINCT (coalesce(instance, '?'), pid)) AS worker_processes,
      max(inflight) AS inflight_max, CAST(sum(inflight) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS inflight_mean,
      {_median_sql('CAST(rows AS DOUBLE)')} AS batch_rows_median,
      {_median_sql('nullif(us_per_row, 0)')} AS us_per_row_median,
      CASE WHEN count(nullif(us_per_row, 0)) > 20 THEN list_sort(list(us_per_row) FILTER (WHERE us_per_row <> 0))[
        CAST(floor(count(nullif(us_per_row, 0)) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] END AS us_per_row_p95,
      {_median_sql('cpu_us_per_row')} AS cpu_us_per_row_median, {_median_sql('cpu_share')} AS cpu_share_median
    FROM costs GROUP BY {keys}"""


def _concurrency_sql(keys: str) -> str:
    return f"""edges AS (SELECT {keys}, epoch_us(ts) AS stop, epoch_us(ts) - CAST(round(total_ms * 1000) AS BIGINT) AS start FROM log),
    steps AS (SELECT {keys}, start AS t, 1 AS step FROM edges UNION ALL SELECT {keys}, stop, -1 FROM edges),
    levels AS (SELECT {keys}, t, step, sum(step) OVER w AS live, lead(t) OVER w - t AS lasting FROM steps
      WINDOW w AS (PARTITION BY {keys} ORDER BY t, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    concurrency AS (SELECT {keys}, CAST(max(live) AS BIGINT) AS concurrency_peak,
      CAST(sum(live * coalesce(lasting, 0)) AS DOUBLE) / CAST(max(t) - min(t) AS DOUBLE) AS concurrency_mean,
      CAST(max(t) - min(t) AS DOUBLE) / 1000000 AS busy_window_s FROM levels GROUP BY {keys})"""


def _as_lines(spark, folder):
    """The events as raw log lines: some without payload, some with only a receive time, some broken."""
    log = spread(service_log(spark, folder), "event_id")
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.struct("event", "instance", "pid", "mode", "rows", "inflight", "total_ms", "work_ms", "cpu_ms", "status")
    line = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 11 == 0, "yesterday").otherwise(written)).alias("timestamp"),
            written.alias("receiveTimestamp"),
            F.concat(F.lit("svc-"), F.col("event_id") % 2).alias("service"),
            F.when(F.col("event_id") % 13 != 0, payload).alias("jsonPayload"),
        )
    )
    return log.select(F.when(F.col("event_id") % 17 == 0, "not json").otherwise(line).alias("value"))


_SCANNED = f"""WITH {_LOG} SELECT * FROM log WHERE event_id % 17 <> 0 AND event_id % 13 <> 0
    AND (event_id % 7 = 0 OR event_id % 11 <> 0) AND event_id % 2 = 1
    AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'"""


def _scan(spark, folder, events):
    return scan_log(
        parse_lines(_as_lines(spark, folder)), "svc-1", "2024-01-03T00:00:00Z", "2024-01-20T00:00:00Z", events
    )


@query(f"SELECT epoch_us(ts) AS ts_us, pid, rows, total_ms FROM ({_SCANNED}) WHERE event = 'batch'")
def log_scan(spark, folder):
    scanned = _scan(spark, folder, ("batch",))
    return scanned.select(F.unix_micros("ts").alias("ts_us"), "payload.pid", "payload.rows", "payload.total_ms")


@query(f"SELECT epoch_us(ts) AS ts_us, pid, false AS out_of_order FROM ({_SCANNED}) WHERE event = 'batch'")
def log_scan_ordered(spark, folder):
    """The scan in order of time: within each partition no line is older than the one before."""
    lines = parse_lines(_as_lines(spark, folder))
    scanned = scan_log(lines, "svc-1", "2024-01-03T00:00:00Z", "2024-01-20T00:00:00Z", ordered=True)
    told = scanned.select(F.unix_micros("ts").alias("ts_us"), "payload.pid")

    def checked(batches):
        import numpy as np
        import pyarrow as pa

        last = np.iinfo(np.int64).min
        for batch in batches:
            times = np.concatenate(([last], batch.column("ts_us").to_numpy()))
            last = times[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(times[1:] < times[:-1])], ["ts_us", "pid", "out_of_order"])

    return told.mapInArrow(checked, "ts_us long, pid long, out_of_order boolean")


@query(f"SELECT event, instance, count(*) AS lines, CAST(sum(rows) AS BIGINT) AS rows FROM ({_SCANNED}) GROUP BY event, instance")
def log_payloads(spark, folder):
    lines = payloads(_scan(spark, folder, ("batch", "batch_error")))
    return lines.groupBy("event", "instance").agg(F.count("*").alias("lines"), F.sum("rows").alias("rows"))


@query(f"WITH {_LOG} SELECT event_id, us_per_row, cpu_us_per_row, cpu_share, CASE WHEN total_ms <> 0 THEN rows / (total_ms / 1000) ELSE 0 END AS rps FROM costs")
def row_costs(spark, folder):
    logs = sl.per_row_costs(service_log(spark, folder))
    rate = sl.throughput(F.col("rows").cast("double"), F.col("total_ms") / 1000)
    return logs.select("event_id", "us_per_row", "cpu_us_per_row", "cpu_share", rate.alias("rps"))


@query(
    f"""WITH {_LOG} SELECT mode, CAST(sum(CASE WHEN event = 'batch' THEN rows ELSE 0 END) AS DOUBLE) / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000) AS rps
    FROM log GROUP BY mode"""
)
def good_throughput(spark, folder):
    """Rows of the batches that went well over the wall-clock time, per mode."""
    wall = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1_000_000
    ok_rows = F.sum(F.when(F.col("event") == "batch", F.col("rows")).otherwise(0)).cast("double")
    return service_log(spark, folder).groupBy("mode").agg(sl.throughput(ok_rows, wall).alias("rps"))


@query(f"WITH {_LOG} {_summary_sql('mode')}")
def log_summary(spark, folder):
    return sl.summarise(sl.per_row_costs(service_log(spark, folder)), ["mode"])


@query(f"WITH {_LOG} {_summary_sql('event, pid')}")
def log_summary_small_groups(spark, folder):
    """Many small groups: most of them too small for a p95."""
    return sl.summarise(sl.per_row_costs(service_log(spark, folder)), ["event", "pid"])


@query(f"WITH {_LOG}, {_concurrency_sql('mode')} SELECT * FROM concurrency")
def log_concurrency(spark, folder):
    return sl.concurrency(service_log(spark, folder), ["mode"])


@query(f"WITH {_LOG}, {_concurrency_sql('everything')} SELECT concurrency_peak, concurrency_mean, busy_window_s FROM concurrency".replace(
    "SELECT everything, epoch_us", "SELECT 1 AS everything, epoch_us"))
def log_concurrency_overall(spark, folder):
    """The whole log as one group."""
    return sl.concurrency(service_log(spark, folder), [])


@query(f"WITH {_LOG}, {_concurrency_sql('instance')}, summary AS ({_summary_sql('instance')}) SELECT summary.*, concurrency_peak, concurrency_mean, busy_window_s FROM summary JOIN concurrency ON summary.instance IS NOT DISTINCT FROM concurrency.instance")
def log_full_summary(spark, folder):
    """Summary and concurrency per instance, lines without an instance included."""
    return sl.summarise_with_concurrency(sl.per_row_costs(service_log(spark, folder)), ["instance"])


# one window of 36 hours per nation, starting 28 hours apart, so that neighbours overlap
_WINDOWS = """windows AS (SELECT n_name AS variant, TIMESTAMP '2024-01-01 00:00:00' + to_hours(n_nationkey * 28) AS start,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(n_nationkey * 28 + 36) AS "end" FROM nation)"""


def _windows(spark, folder):
    start = F.timestamp_add("HOUR", F.col("n_nationkey") * 28, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("variant"), start.alias("start"), F.timestamp_add("HOUR", F.lit(36), start).alias("end")
    )


@query(
    f"""WITH {_LOG}, {_WINDOWS} SELECT variant, count(*) AS lines, CAST(sum(rows) AS BIGINT) AS rows FROM log JOIN windows
    ON ts >= start - INTERVAL 2 SECOND AND ts <= "end" + INTERVAL 2 SECOND GROUP BY variant"""
)
def window_lines(spark, folder):
    """Overlapping windows: a line counts in each."""
    hits = sl.assign_windows(service_log(spark, folder), sl.padded(_windows(spark, folder)))
    return hits.groupBy("variant").agg(F.count("*").alias("lines"), F.sum("rows").alias("rows"))


@query(
    f"""WITH {_LOG}, {_WINDOWS} SELECT variant, count(*) AS lines FROM log JOIN windows
    ON ts >= start - INTERVAL 2 SECOND AND ts <= "end" + INTERVAL 5 SECOND GROUP BY variant"""
)
def window_lines_uneven(spark, folder):
    """Windows widened more behind than before."""
    hits = sl.assign_windows(service_log(spark, folder), sl.padded(_windows(spark, folder), 2, after=5))
    return hits.groupBy("variant").agg(F.count("*").alias("lines"))


@query(
    f"""WITH {_LOG}, {_WINDOWS}, burst AS (SELECT * REPLACE (CASE WHEN event_id % 10 < 9 THEN TIMESTAMP '2024-01-05 10:00:00' + (event_id % 3600) * INTERVAL 1 SECOND ELSE ts END AS ts) FROM log)
    SELECT variant, count(*) AS lines, CAST(sum(rows) AS BIGINT) AS rows FROM burst JOIN windows ON ts >= start AND ts <= "end" GROUP BY variant"""
)
def window_lines_burst(spark, folder):
    """Nine tenths of the log in one hour, which is dealt out in shares."""
    second = F.make_dt_interval(secs=(F.col("event_id") % 3600).cast("decimal(18,6)"))
    burst = F.lit("2024-01-05 10:00:00").cast("timestamp") + second
    log = service_log(spark, folder).withColumn("ts", F.when(F.col("event_id") % 10 < 9, burst).otherwise(F.col("ts").cast("timestamp")))
    hits = sl.assign_windows(log, _windows(spark, folder), lines_a_share=500)
    return hits.groupBy("variant").agg(F.count("*").alias("lines"), F.sum("rows").alias("rows"))


@query(
    f"""WITH {_LOG}, {_WINDOWS} SELECT variant, count(event_id) AS endpoint_invocations,
    count(*) FILTER (WHERE event = 'batch_error') AS failed,
    count(*) FILTER (WHERE event = 'batch_error' AND status IN (408, 429, 500, 503, 504)) AS retryable
    FROM windows LEFT JOIN log ON ts >= start AND ts <= "end" GROUP BY variant"""
)
def retry_report(spark, folder):
    return sl.retry_report(service_log(spark, folder), _windows(spark, folder))


@query(
    """SELECT element, CAST(sum(n) AS BIGINT) AS "values", count(*) AS batches FROM (
      SELECT 'ssn' AS element, event_id % 9 AS n FROM events UNION ALL
      SELECT 'email', event_id % 5 FROM events WHERE event_id % 2 = 0) GROUP BY element"""
)
def element_totals(spark, folder):
    key = F.col("event_id")
    elements = F.when(key % 2 == 0, F.create_map(F.lit("ssn"), key % 9, F.lit("email"), key % 5)).otherwise(
        F.create_map(F.lit("ssn"), key % 9)
    )
    return sl.element_totals(table(spark, folder, "events").select(elements.alias("elements")))


@query(
    """WITH runs AS (SELECT user_id % 20 AS function, (['baseline', 'noop', 'full'])[CAST(event_id % 3 AS INTEGER) + 1] AS query,
        CAST(round(value * 100) AS BIGINT) AS seconds, 1000 AS rows FROM events),
      costs AS (SELECT function, CAST(sum(seconds) FILTER (WHERE query = 'baseline') AS DOUBLE) / CAST(sum(rows) FILTER (WHERE query = 'baseline') AS DOUBLE) AS baseline_per_row,
        CAST(sum(seconds) FILTER (WHERE query = 'noop') AS DOUBLE) / CAST(sum(rows) FILTER (WHERE query = 'noop') AS DOUBLE) AS noop_per_row,
        CAST(sum(seconds) FILTER (WHERE query = 'full') AS DOUBLE) / CAST(sum(rows) FILTER (WHERE query = 'full') AS DOUBLE) AS full_per_row FROM runs GROUP BY function)
    SELECT *, noop_per_row - baseline_per_row AS transit_per_row, full_per_row - noop_per_row AS transform_per_row FROM costs"""
)
def latency_deltas(spark, folder):
    runs = table(spark, folder, "events").select(
        (F.col("user_id") % 20).alias("function"),
        F.get(F.array(F.lit("baseline"), F.lit("noop"), F.lit("full")), (F.col("event_id") % 3).cast("int")).alias("query"),
        F.round(F.col("value") * 100).cast("long").alias("seconds"), F.lit(1000).alias("rows"),
    )
    return sl.latency_deltas(runs, ["function"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ERROR_ROWS = ", ".join(f"({i}, {_quoted(k)}, {_quoted(v)})" for i, (k, v) in enumerate(errors.ERROR_TEXTS.items()))
_KEYS = len(errors.ERROR_TEXTS)


@query(
    f"""WITH known(ord, key, text) AS (VALUES {_ERROR_ROWS}),
    said AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN key WHEN 1 THEN 'Protect failed. ' || key
        WHEN 2 THEN 'Unprotect FAILED. 10.0.0.' || (event_id % 200) || ':' || key WHEN 3 THEN '  ' || key || ' (code 7)'
        WHEN 4 THEN substr(key, 1, 9) ELSE 'Nothing known about ' || event_id END AS message,
        CASE event_id % 6 WHEN 3 THEN key || ' (code 7)' WHEN 4 THEN trim(substr(key, 1, 9)) WHEN 5 THEN 'Nothing known about ' || event_id ELSE key END AS core
      FROM events JOIN known ON ord = event_id % {_KEYS}),
    distinct_cores AS (SELECT DISTINCT core FROM said),
    found AS (SELECT core, coalesce(max(text) FILTER (WHERE core = key), arg_min(text, ord)) AS text
      FROM distinct_cores JOIN known ON starts_with(core, key) OR starts_with(key, core) GROUP BY core)
    SELECT event_id, coalesce(text, message) AS normalised FROM said LEFT JOIN found USING (core)"""
)
def normalised_errors(spark, folder):
    """Messages as callers see them: bare, behind an operation, behind a place, longer and shorter than
    the known text, and unknown."""
    key = F.get(F.array(*[F.lit(k) for k in errors.ERROR_TEXTS]), (F.col("event_id") % _KEYS).cast("int"))
    number = F.col("event_id")
    message = (
        F.when(number % 6 == 0, key)
        .when(number % 6 == 1, F.concat(F.lit("Protect failed. "), key))
        .when(number % 6 == 2, F.concat(F.lit("Unprotect FAILED. 10.0.0."), (number % 200).cast("string"), F.lit(":"), key))
        .when(number % 6 == 3, F.concat(F.lit("  "), key, F.lit(" (code 7)")))
        .when(number % 6 == 4, F.substring(key, 1, 9))
        .otherwise(F.concat(F.lit("Nothing known about "), number.cast("string")))
    )
    return table(spark, folder, "events").select("event_id", errors.normalise(message).alias("normalised"))
