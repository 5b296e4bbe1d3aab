"""The same column functions on streams, and what a live log tells: counts, quantiles, concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.detect import TextConfig
from ..functions.keys import TokenKey
from ..operators.text import redact
from ..operators.tokens import tokenize_table

# fixed value: seconds after which a log line counts as late
SETTLE_SECONDS = 20


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tokenize_stream(stream: DataFrame, elements: dict[str, str] | None = None, key: TokenKey | None = None) -> DataFrame:
    """Stateless: each row is handled on its own, as in a batch."""
    return tokenize_table(stream, elements, key)


def redact_stream(stream: DataFrame, text: str, config: TextConfig) -> DataFrame:
    return stream.withColumn(text, redact(text, config))


def live_summary(stream: DataFrame, keys: list[str], every: str = "1 hour", late: str = f"{SETTLE_SECONDS} seconds", ts: str = "ts") -> DataFrame:
    """Counts and sums of a batch log per tumbling window; rows later than the watermark are dropped.
    State holds one row per open window and key.  The medians are approximate: exact ones cannot be
    streamed."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, every).alias("window"), *keys)
        .agg(
            F.count("*").alias("log_batches"),
            F.sum("rows").alias("log_rows_total"),
            F.max("rows").alias("batch_rows_max"),
            F.percentile_approx("rows", 0.5).alias("batch_rows_median_approx"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys,
                "log_batches", "log_rows_total", "batch_rows_max", "batch_rows_median_approx")
    )


SKETCH_K = 1000  # of the quantile sketches: ranks are off by about 0.3 %
SKETCH_REGISTERS = 12  # of the distinct counts, as a power of two: off by about 1.6 %


def live_sketches(
    stream: DataFrame, keys: list[str], measures: list[str], every: str = "1 hour", late: str = f"{SETTLE_SECONDS} seconds", ts: str = "ts",
    instance: str = "instance",
) -> DataFrame:
    """For each tumbling window and group the lines, a quantile sketch of each measure and a sketch of the distinct
    instances.  State is a few kilobytes a window and group, however many lines it has; sketches of several windows or
    streams merge by :func:`merged_sketches`.  NULL measures and empty instances are left out."""
    known = F.when(F.col(instance) != "", F.col(instance))
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, every).alias("window"), *keys)
        .agg(
            F.count("*").alias("log_batches"),
            *[F.kll_sketch_agg_double(F.col(m).cast("double"), SKETCH_K).alias(f"{m}_sketch") for m in measures],
            F.hll_sketch_agg(known, SKETCH_REGISTERS).alias("instance_sketch"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "log_batches",
                *[f"{m}_sketch" for m in measures], "instance_sketch")
    )


def merged_sketches(windows: DataFrame, keys: list[str], measures: list[str], p95_above: int = 20) -> DataFrame:
    """Median, p95 (only above so many values) and distinct instances of each group over any windows, from their
    sketches alone.  A group without values has no quantiles."""
    merged = windows.groupBy(*keys).agg(
        F.sum("log_batches").alias("log_batches"),
        *[F.kll_merge_agg_double(f"{m}_sketch", SKETCH_K).alias(f"{m}_sketch") for m in measures],
        F.hll_union_agg("instance_sketch").alias("instance_sketch"),
    )

    def quantile(measure: str, share: float, above: int):
        sketch = F.col(f"{measure}_sketch")
        enough = F.when(F.kll_sketch_get_n_double(sketch) > above, sketch)
        return F.kll_sketch_get_quantile_double(enough, F.lit(share))

    return merged.select(
        *keys, "log_batches", F.hll_sketch_estimate("instance_sketch").alias("instances"),
        *[quantile(m, 0.5, 0).alias(f"{m}_median") for m in measures],
        *[quantile(m, 0.95, p95_above).alias(f"{m}_p95") for m in measures],
    )


_MICROS = 1_000_000
_STATE = "instants binary, nets binary"


def _merged_edges(held: tuple, frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Instants with the net change at each, of those held and those that came."""
    instants, nets = ([np.frombuffer(h, np.int64)] for h in held)
    for frame in frames:
        instants.append(frame["_t"].to_numpy(np.int64))
        nets.append(frame["_step"].to_numpy(np.int64))
    distinct, back = np.unique(np.concatenate(instants), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, np.concatenate(nets))
    return distinct, total


def live_cells(
    stream: DataFrame, keys: list[str], cell_seconds: int = 60, longest_seconds: int = 3600, late: str = f"{SETTLE_SECONDS} seconds",
    ts: str = "ts", duration_ms: str = "total_ms",
) -> DataFrame:
    """How the level of running requests moves within each cell of time: ``net`` change, ``high``est level above the one it
    begins with, and ``area`` (the sum of -net * microseconds since the cell began).

    Every line is two edges, its start and its end; the edges of a cell are state until no line that is not late can
    reach it: a line later than ``late`` behind the newest is dropped whole, and a request longer than
    ``longest_seconds`` counts as that long.  So no edge ever meets a closed cell, and levels never drift.  State is one
    number an instant of the open cells; a busy group has as many keys as open cells."""
    cell, longest = cell_seconds * _MICROS, longest_seconds * _MICROS
    stop = F.unix_micros(F.col(ts).cast("timestamp"))
    start = F.greatest(stop - F.round(F.col(duration_ms) * 1000).cast("long"), stop - F.lit(longest))
    edge = F.explode(F.array(F.struct(start.alias("_t"), F.lit(1).alias("_step")), F.struct(stop.alias("_t"), F.lit(-1).alias("_step"))))
    edges = (
        stream.withWatermark(ts, late)
        .filter(F.col(duration_ms).isNotNull() & ~F.isnan(duration_ms) & F.col(ts).isNotNull())
        .select(*keys, ts, edge.alias("_e"))
        .select(*keys, ts, "_e.*")
        .withColumn("_cell", F.floor(F.col("_t") / cell).cast("long") * cell)
    )
    kinds = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)

    def moved(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin = int(key[-1])
        if state.hasTimedOut:
            instants, nets = (np.frombuffer(h, np.int64) for h in state.get)
            state.remove()
            row = [*key[:-1], begin, int(nets.sum()), int(np.cumsum(nets).max()), int((-nets * (instants - begin)).sum())]
            yield pd.DataFrame([row], columns=[*keys, "cell", "net", "high", "area"])
            return
        instants, nets = _merged_edges(state.get if state.exists else (b"", b""), frames)
        state.update((instants.tobytes(), nets.tobytes()))
        closes = (begin + cell + longest) // 1000
        state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))

    return edges.groupBy(*keys, "_cell").applyInPandasWithState(
        moved, f"{kinds}, cell long, net long, high long, area long", _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def concurrency_by_window(cells: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Peak and time-weighted mean level in each window of time that has an edge, from closed cells.  The level a window
    begins with is the sum of all changes before: over windows first, then over the cells of one, so no window function
    holds more than the windows of a group or the cells of a window."""
    size = seconds * _MICROS
    placed = cells.withColumn("_window", F.floor(F.col("cell") / size).cast("long") * size)
    inside = Window.partitionBy(*keys, "_window").orderBy("cell")
    within = placed.withColumn("_before", F.sum("net").over(inside) - F.col("net"))
    windows = within.groupBy(*keys, "_window").agg(
        F.sum("net").alias("_net"), F.max(F.col("_before") + F.col("high")).alias("_high"),
        F.sum(F.col("net").cast("decimal(38,0)") * (F.col("_window") + size - F.col("cell")) + F.col("area")).alias("_area"),
    )
    level = F.sum("_net").over(Window.partitionBy(*keys).orderBy("_window")) - F.col("_net")
    entered = windows.withColumn("_level", level)
    return entered.select(
        *keys, F.timestamp_micros("_window").alias("window_start"),
        F.greatest(F.col("_level"), F.col("_level") + F.col("_high")).alias("concurrency_peak"),
        ((F.col("_area") + F.col("_level").cast("decimal(38,0)") * size).cast("double") / size).alias("concurrency_mean"),
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Exactly-once parquet sink.  Without ``continuous`` (a processing interval) all data available now is
    worked through and the query ends."""
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
