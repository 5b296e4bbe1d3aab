"""Service logs: one structured JSON line per batch, as a log sink delivers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("instance", T.StringType()),
        T.StructField("revision", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("thread", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("elements", T.MapType(T.StringType(), T.LongType())),
        T.StructField("work_ms", T.DoubleType()),
        T.StructField("cpu_ms", T.DoubleType()),
        T.StructField("total_ms", T.DoubleType()),
        T.StructField("inflight", T.LongType()),
        T.StructField("inflight_peak", T.LongType()),
        T.StructField("us_per_row", T.DoubleType()),
        T.StructField("cpu_us_per_row", T.DoubleType()),
        T.StructField("cpu_share", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("status", T.LongType()),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("receiveTimestamp", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("jsonPayload", PAYLOAD),
    ]
)


def parse_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Log lines held as JSON text -> envelope columns; a line that is no JSON gives NULLs.  A line is read once, whatever
    is filtered and picked later: columns of a generator are not written out again in the filters above it."""
    return df.select(F.inline(F.array(F.from_json(line, ENVELOPE))))


def scan_log(
    envelopes: DataFrame, service: str | None = None, start: Column | str | None = None,
    end: Column | str | None = None, events: tuple[str, ...] = ("batch",), ordered: bool = False,
) -> DataFrame:
    """(ts, payload) of one service, between two instants (both inclusive), for the given events.  An
    absent or empty time falls back to the receive time; lines without payload or a readable time are dropped.  Sorting by
    time is on request, since nothing downstream needs it."""
    ts = F.try_to_timestamp(F.coalesce(F.nullif("timestamp", F.lit("")), "receiveTimestamp"))
    rows = envelopes.filter(F.col("jsonPayload").isNotNull() & F.col("jsonPayload.event").isin(*events))
    if service is not None:
        rows = rows.filter(F.col("service") == service)
    # the time is read once for all of its filters, as the line is in parse_lines
    rows = rows.select(F.inline(F.array(F.struct(ts.alias("ts"), F.col("jsonPayload").alias("payload"))))).filter(F.col("ts").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("ts") >= _instant(start))
    if end is not None:
        rows = rows.filter(F.col("ts") <= _instant(end))
    return rows.orderBy("ts") if ordered else rows


def _instant(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def payloads(scanned: DataFrame) -> DataFrame:
    """Only the payload's columns."""
    return scanned.select("payload.*")
