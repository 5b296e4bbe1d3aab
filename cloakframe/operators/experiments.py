"""Statistics over repeated measurements: robust summaries, honest rankings, drift, line fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ranking import exact_medians, join_groups, ranked
from .slopes import median_slope

# --- fixed values -------------------------------------------------------------------------------------
FIT_FROM = 4
ROUNDS_PATTERN = r"cpu_r(\d+)_b"
NO_COST_ROWS_PER_SECOND = 1e9
# (CPU share from, to), (us/row from, to), worker class, workers, threads, slots, scale first, basis;
# bands are half open, slots and threads as published
DECISION_TABLE = [
    (0.9, None, None, 1.0, "sync", "4", "1", "4", "vertical", "W1, measured"),
    (0.9, None, 1.0, 10.0, "sync", "16", "1", "16", "vertical", "W2, measured"),
    (0.9, None, 10.0, 50.0, "sync", "4 - 16", "1", "4 - 16", "vertical", "W3, measured"),
    (0.9, None, 50.0, 200.0, "sync", "16", "1", "16", "horizontal", "W4"),
    (0.9, None, 200.0, None, "sync", "16", "1", "16", "horizontal", "interpolated from W4"),
    (0.05, 0.5, None, None, "sync", "32", "1", "32", "vertical", "W6, tested only to 64 slots"),
    (None, 0.05, None, None, "gthread", "4", "16 - 32", "64 - 128", "vertical", "W5, W7, measured"),
]
# ------------------------------------------------------------------------------------------------------


def median_by(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Group size and the median of each numeric field, missing values left out.  A NULL key is a group."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    long = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("_measured")
    ).select(*keys, "_measured.*")
    medians = exact_medians(long, [*keys, "field"], "v")
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == f, F.col("median"))).alias(f"{f}_median") for f in fields]
    )
    return join_groups(counts, wide, keys, "left")


def spread_by(df: DataFrame, keys: list[str], value: str = "rps") -> DataFrame:
    """n, min, median, max and spread (max / min, infinite for min 0) per group that has any value."""
    present = df.filter(F.col(value).isNotNull())
    ends = present.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max")
    )
    both = join_groups(ends, exact_medians(present, keys, value), keys)
    return both.withColumn(
        "spread", F.when(F.col("min") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("max"), F.col("min")))
    )


def mean_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, min and max per group, at any magnitude.  Sums of doubles may differ in their last digits with
    the order of the rows, unless the values are exactly representable together."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def rank_configs(
    df: DataFrame, within: list[str], config: list[str], value: str = "rps", sentinel: str = "sentinel",
    extra: list[str] = [],
) -> DataFrame:
    """Rank configurations by median, best first, with the comparison that the samples support:

    ``best``; ``slower`` when even its maximum is below the best one's minimum; ``indistinguishable``
    otherwise.  Sentinel re-runs take no part; equal medians are ordered by configuration.  ``extra`` names
    further measures whose medians stand beside the value's (``<name>_median``)."""
    if not within:
        whole = rank_configs(df.withColumn("_all", F.lit(0)), ["_all"], config, value, sentinel, extra)
        return whole.drop("_all")
    runs = df.filter(~F.coalesce(F.col(sentinel), F.lit(False)))
    stats = spread_by(runs, [*within, *config], value)
    if extra:
        medians = median_by(runs.filter(F.col(value).isNotNull()), [*within, *config], extra).drop("n")
        stats = join_groups(stats, medians, [*within, *config])
    placed = ranked(stats, within, "median", config)
    leader = F.min_by(F.struct("median", "min"), F.struct(-F.col("median"), *config))
    best = stats.groupBy(*within).agg(leader.alias("_best")).select(
        *within, F.col("_best.median").alias("best_median"), F.col("_best.min").alias("best_min")
    )
    joined = join_groups(placed, best, within)
    verdict = (
        F.when(F.col("rank") == 1, "best").when(F.col("max") < F.col("best_min"), "slower").otherwise("indistinguishable")
    )
    return joined.withColumn("verdict", verdict).withColumn("vs_best", F.try_divide("median", "best_median")).drop(
        "best_median", "best_min"
    )


def tied_with_best(ranking: DataFrame, within: list[str], config: list[str]) -> DataFrame:
    """Configurations that cannot be told from the best, one row each."""
    return ranking.filter(F.col("verdict") == "indistinguishable").select(*within, F.concat_ws("/", *config).alias("config"), "rank")


def drift(df: DataFrame, keys: list[str], value: str = "rps", sentinel: str = "sentinel") -> DataFrame:
    """First run against sentinel re-run per group that has both: drifted when the ranges do not overlap."""
    runs = df.filter(F.col(sentinel).isNotNull() & F.col(value).isNotNull())
    again = F.col(sentinel)
    ends = runs.groupBy(*keys).agg(
        F.min(F.when(~again, F.col(value))).alias("first_min"), F.max(F.when(~again, F.col(value))).alias("first_max"),
        F.min(F.when(again, F.col(value))).alias("again_min"), F.max(F.when(again, F.col(value))).alias("again_max"),
    ).filter("first_min IS NOT NULL AND again_min IS NOT NULL")
    medians = exact_medians(runs, [*keys, sentinel], value).groupBy(*keys).agg(
        F.max(F.when(~again, F.col("median"))).alias("first_median"), F.max(F.when(again, F.col("median"))).alias("again_median")
    )
    overlaps = (F.col("first_min") <= F.col("again_max")) & (F.col("again_min") <= F.col("first_max"))
    return join_groups(ends, medians, keys).withColumn("drifted", ~overlaps)


def rounds_of(function: Column | str) -> Column:
    """The number of rounds written in a function's name, or NULL."""
    function = F.col(function) if isinstance(function, str) else function
    digits = F.regexp_extract(function, ROUNDS_PATTERN, 1)
    beyond = F.raise_error(F.concat(F.lit("rounds beyond a long: "), function)).cast("long")

    def number(found: Column) -> Column:
        found = F.nullif(found, F.lit(""))
        return F.when(found.isNull() | (F.length(F.ltrim(found, F.lit("0"))) <= 18), found.cast("long")).otherwise(beyond)

    return F.transform(F.array(digits), number)[0]  # the pattern is looked for once


def calibration_curve(df: DataFrame, keys: list[str], point: str, x: str, y: str) -> DataFrame:
    """One point per ``point`` (a function): its x and the median y of its measurements; points without a y,
    or with y = 0, are left out.  Several points may share an x.  The measurements are stored in these columns, as the
    medians read them three times and ``x`` may be costly."""
    measured = settle(df.select(*keys, point, x, y), "measured")
    points = exact_medians(measured.filter(F.col(x).isNotNull()), [*keys, point, x], y, "y")
    return points.select(*keys, F.col(point).alias("point"), F.col(x).alias("x"), "y").filter("y != 0")


def theil_sen(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Robust line through a curve's points with x >= 4: slope is the median of the slopes of all pairs of
    different x, the floor the median residual, not below 0; plus the point farthest from the line.

    A curve has one point per function, however many measurements are behind it, and is one task's two columns of
    numbers; its pairs are counted and never written out (see :mod:`.slopes`).  Points whose y is no finite number
    are in no pair.  A curve without two different x has no slope."""
    points = settle(curve.filter(F.col("x") >= FIT_FROM), "curve")
    kinds = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), "slope double"])

    def sloped(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy().astype(float) for c in ("x", "y"))
        finite = np.isfinite(x) & np.isfinite(y)
        slope = pa.array([median_slope(x[finite], y[finite])], pa.float64())
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), slope], names=[*keys, "slope"])

    slope = points.select(*keys, F.col("x").cast("double").alias("x"), "y").groupBy(*keys).applyInArrow(sloped, kinds).filter("slope IS NOT NULL")
    leaning = settle(join_groups(points, slope, keys), "leaning")
    rests = leaning.select(*keys, (F.col("y") - F.col("slope") * F.col("x")).alias("rest"))
    floor = exact_medians(rests, keys, "rest", "floor").withColumn("floor", F.greatest("floor", F.lit(0.0)))
    fitted = join_groups(leaning, floor, keys).withColumn("fitted", F.col("floor") + F.col("slope") * F.col("x"))
    # of equal residuals the smallest x, then the point first by name
    worst = F.min_by(F.struct("point", "x", "y", "fitted"), F.struct(-F.abs(F.col("y") - F.col("fitted")), "x", "point"))
    lines = fitted.groupBy(*keys).agg(
        F.max("slope").alias("slope"), F.max("floor").alias("floor"), F.count("*").alias("points"), worst.alias("_worst")
    )
    return lines.select(
        *keys, "slope", "floor", "points",
        *[F.col(f"_worst.{c}").alias(f"worst_{c}") for c in ("point", "x", "y", "fitted")],
    )


def wait_over_service(share: Column) -> Column:
    """(1 - share) / share: infinite when the CPU was never busy, NULL when it was not measured."""
    return F.when(share <= 0, F.lit(float("inf"))).otherwise((1 - share) / share)


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """The numbers a scaling decision needs, per workload."""
    fields = ["us_per_row_median", "cpu_us_per_row_median", "cpu_share_median", "rps"]
    medians = median_by(df, keys, fields)
    named = medians.select(*keys, "n", *[F.col(f"{f}_median").alias(f.removesuffix("_median")) for f in fields])
    return named.withColumn("wait_over_service", wait_over_service(F.col("cpu_share")))


def predicted_slots(cores: Column, cpu_us: Column, wait_ms: Column) -> Column:
    """cores * (1 + wait / service); a workload that only waits wants unboundedly many."""
    idle = F.when(wait_ms != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    ratio = F.when(cpu_us <= 0, idle).otherwise(wait_ms * 1000 / cpu_us)
    return cores * (1 + ratio)


def rows_per_second_per_slot(cpu_us: Column, wait_ms: Column) -> Column:
    seconds = cpu_us / 1e6 + wait_ms / 1e3
    return F.when(seconds <= 0, F.lit(NO_COST_ROWS_PER_SECOND)).otherwise(F.lit(1.0) / seconds)


def recommend(df: DataFrame, share: str = "cpu_share", cost: str = "us_per_row") -> DataFrame:
    """Attach the decision table's row for (CPU share, us/row); a pair between the bands has none."""
    names = ("worker_class", "workers", "threads", "slots", "scale_first", "basis")

    def within(column: str, low, high) -> Column:
        inside = F.col(column).isNotNull()
        if low is not None:
            inside = inside & (F.col(column) >= low)
        return inside if high is None else inside & (F.col(column) < high)

    advice = F.coalesce(
        *[
            F.when(
                within(share, *band[:2]) & within(cost, *band[2:4]),
                F.struct(*[F.lit(v).alias(n) for n, v in zip(names, band[4:])]),
            )
            for band in DECISION_TABLE
        ]
    )
    return df.withColumn("_advice", advice).select(*df.columns, *[F.col(f"_advice.{n}").alias(n) for n in names])


def split_by_label(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Tag each row with the arm whose marker its label contains; a label with two markers is in both arms,
    one with none in neither."""
    arms = F.array_compact(F.array(*[F.when(F.col(column).contains(m), F.lit(arm)) for arm, m in labels.items()]))
    return df.withColumn("arm", F.explode(arms))


def variant_table(df: DataFrame) -> DataFrame:
    """Probe rows by variant, without the equivalence rows; old records keyed by batch are tolerated."""
    probes = df.filter(~F.col("probe").eqNullSafe("equivalence"))
    size = F.coalesce(F.nullif("reply_width", F.lit(0)), F.nullif("batch", F.lit(0)), F.lit(0))
    return probes.select(
        "variant", size.alias("size"),
        F.when(F.col("succeeded"), "OK").otherwise("FAILED").alias("result"),
        "elapsed_s", "log_batches", "log_rows_total", "batch_rows_median",
    ).orderBy("size", "variant")


def equivalence_table(df: DataFrame) -> DataFrame:
    checks = df.filter(F.col("probe").eqNullSafe("equivalence"))
    return checks.select(
        "variant", "mismatches", "compared", F.when(F.col("equivalent"), "equivalent").otherwise("NOT equivalent").alias("result")
    )


def success_ratio(df: DataFrame, keys: list[str], ok: str = "succeeded") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("succeeded"), F.count("*").alias("fired"),
        (F.count_if(ok) / F.count("*")).alias("ratio"),
    )


def pending_cells(plan: DataFrame, done: DataFrame, iterations: int, keys: tuple[str, ...] = ("phase", "config", "function")) -> DataFrame:
    """Cells of a plan that have not been measured ``iterations`` times; sentinel re-runs do not count."""
    complete = (
        done.filter(~F.coalesce(F.col("sentinel"), F.lit(False)))
        .groupBy(*keys)
        .agg(F.count("*").alias("runs"))
        .filter(F.col("runs") >= iterations)
    )
    match = F.lit(True)
    for k in keys:
        match = match & plan[k].eqNullSafe(complete[k])
    return plan.join(complete, match, "left_anti")
