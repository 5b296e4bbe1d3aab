"""What a service did, from its batch log: volumes, latency statistics, true concurrency, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .ranking import LOWER_MEDIAN, UPPER_MEDIAN, exact_picks, join_groups

# --- fixed values -------------------------------------------------------------------------------------
RETRYABLE = (408, 429, 500, 503, 504)
P95_NEEDS_MORE_THAN = 20
WINDOW_PADDING_SECONDS = 2
# ------------------------------------------------------------------------------------------------------

# 0-based index int(0.95 n) of the sorted values; not a percentile function's rule
P95 = f"CASE WHEN size > {P95_NEEDS_MORE_THAN} THEN floor(size * 0.95D) + 1 END"


def per_row_costs(logs: DataFrame) -> DataFrame:
    """us_per_row, cpu_us_per_row and cpu_share from a line's milliseconds; no share without work."""
    rows = F.greatest("rows", F.lit(1))
    return logs.withColumns(
        {
            "us_per_row": F.col("work_ms") * 1000 / rows,
            "cpu_us_per_row": F.col("cpu_ms") * 1000 / rows,
            "cpu_share": F.when(F.col("work_ms") > 0, F.col("cpu_ms") / F.col("work_ms")),
        }
    )


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second, 0 where no time passed."""
    return F.when(seconds != 0, rows / seconds).otherwise(0.0)


def summarise(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Volumes, distinct instances and processes, in-flight levels, medians and p95 per group.

    Counts are combined per (group, instance, pid) first, so the distinct counts need no second pass over
    the log; medians and p95 are exact and read only counts for all but a narrow range of values."""
    per_process = logs.groupBy(*keys, "instance", "pid").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("rows", F.lit(0))).alias("rows"),
        F.max(F.coalesce("rows", F.lit(0))).alias("rows_max"),
        F.sum(F.coalesce("inflight", F.lit(0))).alias("inflight"),
        F.max(F.coalesce("inflight", F.lit(0))).alias("inflight_max"),
    )
    volumes = per_process.groupBy(*keys).agg(
        F.sum("n").alias("log_batches"),
        F.sum("rows").alias("log_rows_total"),
        (F.sum("rows") / F.sum("n")).alias("batch_rows_mean"),
        F.max("rows_max").alias("batch_rows_max"),
        F.count_distinct(F.when(F.col("instance") != "", F.col("instance"))).alias("instances"),
        F.count("*").alias("worker_processes"),
        F.max("inflight_max").alias("inflight_max"),
        (F.sum("inflight") / F.sum("n")).alias("inflight_mean"),
    )
    measures = {
        "rows": F.coalesce("rows", F.lit(0)),
        "us_per_row": F.when(F.col("us_per_row") != 0, F.col("us_per_row")),
        "cpu_us_per_row": F.col("cpu_us_per_row"),
        "cpu_share": F.col("cpu_share"),
    }
    long = logs.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("v")) for m, v in measures.items()])
        ).alias("_measured"),
    ).select(*keys, "_measured.*")
    picks = exact_picks(long, [*keys, "measure"], "v", {"lower": LOWER_MEDIAN, "upper": UPPER_MEDIAN, "p95": P95})

    def pick(measure: str, name: str) -> Column:
        return F.max(F.when((F.col("measure") == measure) & (F.col("pick") == name), F.col("value")))

    def median(measure: str) -> Column:
        return (pick(measure, "lower") + pick(measure, "upper")) / 2

    orders = picks.groupBy(*keys).agg(
        median("rows").alias("batch_rows_median"),
        F.coalesce(median("us_per_row"), F.lit(0.0)).alias("us_per_row_median"),
        pick("us_per_row", "p95").alias("us_per_row_p95"),
        median("cpu_us_per_row").alias("cpu_us_per_row_median"),
        median("cpu_share").alias("cpu_share_median"),
    )
    return join_groups(volumes, orders, keys)


_SECOND, _HOUR = 1_000_000, 3_600_000_000


def concurrency(logs: DataFrame, keys: list[str], end: str = "ts", duration_ms: str = "total_ms") -> DataFrame:
    """How many requests really ran at once, from the intervals [end - duration, end].

    Peak and time-weighted mean level, and the busy window in seconds.  At one instant ends come before
    starts.  The running level is a three-step prefix sum (instants of a second, seconds of an hour,
    hours), each step carrying (net change, highest level inside), so no window is larger than the clock
    allows however many requests a group holds.  Times are microseconds, so sums are exact.
    Lines without an end or a duration (NULL or NaN) take no part."""
    stop = F.unix_micros(F.col(end).cast("timestamp"))
    start = stop - F.round(F.col(duration_ms) * 1000).cast("long")
    edge = F.explode(
        F.array(F.struct(start.alias("_t"), F.lit(1).alias("_step")), F.struct(stop.alias("_t"), F.lit(-1).alias("_step")))
    )
    edges = (
        logs.filter(F.col(duration_ms).isNotNull() & ~F.isnan(duration_ms) & F.col(end).isNotNull())
        .select(*keys, edge.alias("_e"))
        .select(*keys, "_e.*")
    )
    instants = edges.groupBy(*keys, "_t").agg(F.sum("_step").alias("_net"))
    level = instants.select(
        *keys, "_t", "_net", F.col("_net").alias("_high"), F.lit(0).cast("long").alias("_area"),
        F.col("_t").alias("_from"), F.col("_t").alias("_to"),
    )
    for size in (_SECOND, _HOUR, None):
        level = _lifted(level, keys, size)
    window = F.col("_to") - F.col("_from")
    return level.select(
        *keys,
        F.greatest("_high", F.lit(0)).alias("concurrency_peak"),
        F.when(window > 0, F.try_divide(F.col("_area").cast("double"), window)).otherwise(0.0).alias("concurrency_mean"),
        (window / 1_000_000).alias("busy_window_s"),
    )


def _lifted(level: DataFrame, keys: list[str], size: int | None) -> DataFrame:
    """Combine cells of time into larger cells (the whole group when ``size`` is None).

    ``_area`` is the sum of -net * (time since the cell began).  For a whole group, whose net changes sum to
    zero, that is the area under the level.  Offsets within an hour fit a long; from there on decimals."""
    bucket = F.lit(0).cast("long") if size is None else F.floor(F.col("_t") / size).cast("long") * size
    cells = level.withColumn("_bucket", bucket)
    before = F.sum("_net").over(Window.partitionBy(*keys, "_bucket").orderBy("_t")) - F.col("_net")
    wide = (lambda c: c.cast("decimal(19,0)")) if size is None else (lambda c: c)
    moved = wide(F.col("_area")) - wide(F.col("_t") - F.col("_bucket")) * wide(F.col("_net"))
    return (
        cells.withColumn("_high", before + F.col("_high"))
        .groupBy(*keys, "_bucket")
        .agg(
            F.sum("_net").alias("_net"), F.max("_high").alias("_high"), F.sum(moved).alias("_area"),
            F.min("_from").alias("_from"), F.max("_to").alias("_to"),
        )
        .withColumnRenamed("_bucket", "_t")
    )


def summarise_with_concurrency(logs: DataFrame, keys: list[str]) -> DataFrame:
    return join_groups(summarise(logs, keys), concurrency(logs, keys), keys, "left")


LINES_A_SHARE = 1_000_000


def assign_windows(
    logs: DataFrame, windows: DataFrame, ts: str = "ts", bucket_seconds: int = 3600, lines_a_share: int = LINES_A_SHARE
) -> DataFrame:
    """One row per (log row, window) with start <= ts <= end; padded windows may overlap.

    ``windows`` has (start, end) and any other columns.  The range condition becomes an equality on time
    buckets, so the join hashes (or broadcasts, when the windows are few) instead of comparing all pairs.  Lines are
    counted by bucket first, which moves one number a bucket and task: a bucket of more than ``lines_a_share`` lines is
    dealt out in shares by the hash of its lines, and the windows that touch it are copied to each share.  So a
    burst that holds most of a day in one hour is many keys, and nothing is copied elsewhere."""
    width = F.lit(bucket_seconds * 1_000_000)

    def number(t: Column) -> Column:
        return F.floor(F.unix_micros(t.cast("timestamp")) / width).cast("long")

    counted = logs.where(F.col(ts).isNotNull()).groupBy(number(F.col(ts)).alias("_bucket")).agg(F.count("*").alias("_lines"))
    busy = counted.where(F.col("_lines") > lines_a_share).select("_bucket", F.ceil(F.col("_lines") / lines_a_share).cast("int").alias("_shares"))
    busy = settle(busy, "busy")
    spread = windows.withColumn("_bucket", F.explode(F.sequence(number(F.col("start")), number(F.col("end"))))).join(busy, "_bucket", "left")
    spread = spread.withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    line = F.xxhash64(*[F.col(c) for c, kind in logs.dtypes if "map<" not in kind])
    placed = logs.withColumn("_bucket", number(F.col(ts))).join(busy, "_bucket", "left")
    placed = placed.withColumn("_share", F.coalesce(F.pmod(line, F.col("_shares").cast("long")), F.lit(0)).cast("int"))
    inside = (placed[ts] >= spread["start"]) & (placed[ts] <= spread["end"])
    joined = placed.join(spread, (placed["_bucket"] == spread["_bucket"]) & (placed["_share"] == spread["_share"]) & inside)
    return joined.select(*[placed[c] for c in logs.columns], *[spread[c] for c in windows.columns])


def padded(windows: DataFrame, seconds: int = WINDOW_PADDING_SECONDS, after: int | None = None) -> DataFrame:
    """Windows widened by ``seconds`` before and by ``after`` (as many, if not given) behind."""
    front, back = (F.make_dt_interval(secs=F.lit(s)) for s in (seconds, seconds if after is None else after))
    return windows.withColumns({"start": F.col("start") - front, "end": F.col("end") + back})


def retry_report(logs: DataFrame, windows: DataFrame, variant: str = "variant") -> DataFrame:
    """Endpoint hits per variant: every batch and batch_error in its window, how many failed, and how many
    of the failures a caller would retry."""
    hits = assign_windows(logs.filter(F.col("event").isin("batch", "batch_error")), windows)
    failed = F.col("event") == "batch_error"
    counted = hits.groupBy(variant).agg(
        F.count("*").alias("endpoint_invocations"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & F.col("status").isin(*RETRYABLE)).alias("retryable"),
    )
    names = windows.select(variant).distinct()
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("endpoint_invocations", "failed", "retryable")}
    return names.join(counted, variant, "left").withColumns(zeros)


def element_totals(logs: DataFrame, elements: str = "elements") -> DataFrame:
    """Values per data element over all lines, from each line's element counts."""
    pairs = logs.select(F.explode(elements).alias("element", "n"))
    return pairs.groupBy("element").agg(F.sum("n").alias("values"), F.count("*").alias("batches"))


def latency_deltas(runs: DataFrame, keys: list[str], query: str = "query", seconds: str = "seconds", rows: str = "rows") -> DataFrame:
    """Cost per row of the baseline, no-op and full query of a run log, and what transit and the
    transform each add."""

    def per_row(name: str) -> Column:
        chosen = F.col(query) == name
        return F.try_divide(F.sum(F.when(chosen, F.col(seconds))), F.sum(F.when(chosen, F.col(rows))).cast("double"))

    costs = runs.groupBy(*keys).agg(*[per_row(n).alias(f"{n}_per_row") for n in ("baseline", "noop", "full")])
    return costs.withColumns(
        {
            "transit_per_row": F.col("noop_per_row") - F.col("baseline_per_row"),
            "transform_per_row": F.col("full_per_row") - F.col("noop_per_row"),
        }
    )
