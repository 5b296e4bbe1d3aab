"""Sources, sinks and streams, over data that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as tk
from ..operators.service_logs import per_row_costs
from ..session import shared_path
from ..sources.pii import PII_SCHEMA, mock_pii
from ..sources.tables import append_json_lines, field, scan_csv, scan_json_lines, scan_variant_lines, table, write_csv
from ..streaming import live
from .base import PEOPLE, people, people_sql, query
from .service_queries import _LOG, service_log
from .token_queries import stored_tokens
from .text_queries import ORACLE_REDACTED, REDACT


@query(f"{PEOPLE} SELECT * FROM people")
def csv_scan(spark, folder):
    path = shared_path(spark, "csv")
    write_csv(people(spark, folder), path)
    return scan_csv(spark, path, PII_SCHEMA)


@query(
    """SELECT phase, count(*) AS records, count(rps) AS with_rps, count(variant) AS with_variant, min(id) AS first_id, max(id) AS last_id FROM (
      SELECT 'infrastructure' AS phase, o_orderkey AS id, o_totalprice AS rps, NULL AS variant FROM orders
      UNION ALL SELECT 'probe', p_partkey, NULL, p_name FROM part) GROUP BY phase"""
)
def json_lines_scan(spark, folder):
    """Records of two phases appended to one feed and read under one superset schema."""
    path = shared_path(spark, "jsonl")
    append_json_lines(table(spark, folder, "orders").select(F.lit("infrastructure").alias("phase"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rps")), path)
    append_json_lines(table(spark, folder, "part").select(F.lit("probe").alias("phase"), F.col("p_partkey").alias("id"), F.col("p_name").alias("variant")), path)
    records = scan_json_lines(spark, path, "phase STRING, id LONG, rps DOUBLE, variant STRING, sentinel BOOLEAN")
    return records.groupBy("phase").agg(
        F.count("*").alias("records"), F.count("rps").alias("with_rps"), F.count("variant").alias("with_variant"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )


@query(
    """WITH records AS (SELECT 'infrastructure' AS phase, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS rps, NULL AS variant, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 END AS depth FROM orders
      UNION ALL SELECT 'probe', p_partkey, NULL, p_name, NULL FROM part UNION ALL SELECT 'trial', s_suppkey, NULL, NULL, s_suppkey % 5 FROM supplier)
    SELECT phase, count(*) AS records, count(rps) AS with_rps, count(variant) AS with_variant, count(depth) AS with_depth, coalesce(sum(depth), 0)::BIGINT AS depths, min(id) AS first_id, max(id) AS last_id FROM records GROUP BY phase"""
)
def variant_records(spark, folder):
    """Records of three phases in one feed, kept whole: a nested field that no schema names is read out of them."""
    path, number = shared_path(spark, "variant"), F.col("o_orderkey")
    nested = lambda value: F.struct(F.struct(value.alias("depth")).alias("pool"))
    orders = F.struct(F.lit("infrastructure").alias("phase"), number.alias("id"), F.col("o_totalprice").cast("double").alias("rps"), nested(F.when(number % 2 == 0, number % 9)).alias("settings"))
    parts = F.struct(F.lit("probe").alias("phase"), F.col("p_partkey").alias("id"), F.col("p_name").alias("variant"))
    trials = F.struct(F.lit("trial").alias("phase"), F.col("s_suppkey").alias("id"), nested(F.col("s_suppkey") % 5).alias("settings"))
    for name, record in (("orders", orders), ("part", parts), ("supplier", trials)):
        table(spark, folder, name).select(F.to_json(record).alias("value")).write.mode("append").text(path)
    record = scan_variant_lines(spark, path)
    fields = {"phase": "string", "id": "bigint", "rps": "double", "variant": "string", "settings.pool.depth": "bigint"}
    told = record.select(*[field("record", path, kind).alias(path.rpartition(".")[2]) for path, kind in fields.items()])
    return told.groupBy("phase").agg(
        F.count("*").alias("records"), F.count("rps").alias("with_rps"), F.count("variant").alias("with_variant"), F.count("depth").alias("with_depth"),
        F.coalesce(F.sum("depth"), F.lit(0)).alias("depths"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )


@query(
    """SELECT CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN '{broken ' || o_orderkey END AS broken_line
    FROM orders WHERE o_orderkey % 3 <> 1"""
)
def json_lines_broken(spark, folder):
    """A feed with blank and broken lines, read with the broken ones kept apart."""
    path, key = shared_path(spark, "broken"), F.col("o_orderkey")
    line = F.when(key % 3 == 0, F.concat(F.lit("{broken "), key)).when(key % 3 == 1, "  ").otherwise(F.to_json(F.struct(key.alias("id"))))
    table(spark, folder, "orders").select(line.alias("value")).write.text(path)
    return scan_json_lines(spark, path, "id LONG", broken="keep")


@query(f"{PEOPLE} SELECT id, name, email, ssn, dob FROM people")
def token_table(spark, folder):
    """Tokens created as a table, read back and decrypted."""
    return tk.detokenize_table(stored_tokens(spark, folder))


@query(
    f"""WITH mock AS ({people_sql("(SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS n)", "n")})
    SELECT name, count(*) AS people, min(id) AS first_id, max(email) AS last_email, min(ssn) AS first_ssn, max(dob) AS last_dob FROM mock GROUP BY name"""
)
def mock_people(spark, folder):
    """As many generated people as there are orders."""
    rows = mock_pii(spark, table(spark, folder, "orders").count())
    return rows.groupBy("name").agg(
        F.count("*").alias("people"), F.min("id").alias("first_id"), F.max("email").alias("last_email"),
        F.min("ssn").alias("first_ssn"), F.max("dob").alias("last_dob"),
    )


def _run(stream, label):
    """Work through what is there and read the sink."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-state")
    live.append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"{PEOPLE} SELECT id, name, email, ssn, dob FROM people")
def streamed_tokens(spark, folder):
    """The customers as a stream, tokenized into a sink; the sink decrypts to the table."""
    source = shared_path(spark, "people")
    people(spark, folder).write.parquet(source)
    return tk.detokenize_table(_run(live.tokenize_stream(live.read_table_stream(spark, source, PII_SCHEMA)), "tokens"))


@query(ORACLE_REDACTED)
def streamed_redaction(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    source = shared_path(spark, "documents")
    docs.write.parquet(source)
    stream = live.read_table_stream(spark, source, docs.schema)
    return _run(live.redact_stream(stream, "text", REDACT), "redacted")


@query(
    f"""WITH {_LOG}, hours AS (SELECT date_trunc('hour', ts) AS window_start, mode, count(*) AS log_batches,
      CAST(sum(rows) AS BIGINT) AS log_rows_total, max(rows) AS batch_rows_max FROM log GROUP BY 1, 2)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS hour, mode, log_batches, log_rows_total, batch_rows_max FROM hours
    WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 20 SECOND FROM log)"""
)
def live_summary(spark, folder):
    """Hourly summaries of the log as a stream; an hour is reported once the watermark has passed it."""
    source = shared_path(spark, "log")
    log = service_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(source)
    summary = live.live_summary(live.read_table_stream(spark, source, log.schema), ["mode"])
    return _run(summary, "summary").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "mode", "log_batches", "log_rows_total", "batch_rows_max"
    )


#: Requests of the log run for minutes to hours; twelve hours hold all but freaks, which count as that long.
LONGEST_HOURS = 12


@query(
    f"""WITH {_LOG}, spans AS (SELECT mode, epoch_us(ts) AS stop, greatest(epoch_us(ts) - CAST(round(total_ms * 1000) AS BIGINT), epoch_us(ts) - {LONGEST_HOURS * 3600000000}) AS start FROM log),
    steps AS (SELECT mode, start AS t, 1 AS step FROM spans UNION ALL SELECT mode, stop, -1 FROM spans),
    levels AS (SELECT mode, t, step, t // 3600000000 * 3600000000 AS h, sum(step) OVER (PARTITION BY mode ORDER BY t, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live FROM steps),
    hours AS (SELECT mode, h, max(live) AS high, sum(step) AS net, sum(CAST(step AS HUGEINT) * (h + 3600000000 - t)) AS area FROM levels GROUP BY mode, h),
    entered AS (SELECT *, sum(net) OVER (PARTITION BY mode ORDER BY h) - net AS level FROM hours)
    SELECT mode, strftime(make_timestamp(h), '%Y-%m-%d %H:%M') AS hour, CAST(greatest(level, high) AS BIGINT) AS concurrency_peak,
      CAST(area + CAST(level AS HUGEINT) * 3600000000 AS DOUBLE) / 3600000000 AS concurrency_mean
    FROM entered WHERE h + 3600000000 <= (SELECT epoch_us(max(ts)) FROM log) - {(LONGEST_HOURS * 3600 + 120) * 1000000}"""
)
def live_concurrency(spark, folder):
    """Requests running at once by hour, from cells that a stream has closed; hours that the watermark has passed."""
    source = shared_path(spark, "log")
    log = service_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(source)
    cells = live.live_cells(live.read_table_stream(spark, source, log.schema), ["mode"], cell_seconds=3600, longest_seconds=LONGEST_HOURS * 3600)
    hours = live.concurrency_by_window(_run(cells, "cells"), ["mode"])
    newest = log.agg(F.max("ts")).first()[0]
    closed = F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(newest) - F.expr(f"INTERVAL {LONGEST_HOURS * 3600 + 120} SECONDS")
    return hours.where(closed).select("mode", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "concurrency_peak", "concurrency_mean")


@query(
    f"""WITH {_LOG} SELECT mode, count(*) AS log_batches, count(DISTINCT instance) AS instances, true AS median_near, true AS p95_near FROM costs
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 20 SECOND FROM log) GROUP BY mode"""
)
def live_quantiles(spark, folder):
    """Hourly sketches of a stream, merged over all closed hours: distinct instances, and whether the median and the p95
    of the cost a row stand within one hundredth of their true ranks in the log."""
    source = shared_path(spark, "costs")
    log = per_row_costs(service_log(spark, folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(source)
    hours = _run(live.live_sketches(live.read_table_stream(spark, source, log.schema), ["mode"], ["us_per_row"]), "sketches")
    told = live.merged_sketches(hours, ["mode"], ["us_per_row"])
    closed = log.join(hours.select("mode", "window_start"), (log["mode"] == hours["mode"]) & (F.date_trunc("hour", log["ts"]) == hours["window_start"]), "left_semi")
    ranked = closed.select("mode", "us_per_row").join(told, "mode")

    def near(estimate: str, share: float):
        below, up_to = F.avg((F.col("us_per_row") < F.col(estimate)).cast("double")), F.avg((F.col("us_per_row") <= F.col(estimate)).cast("double"))
        return (below <= share + 0.01) & (up_to >= share - 0.01)

    checked = ranked.groupBy("mode", "log_batches", "instances").agg(near("us_per_row_median", 0.5).alias("median_near"), near("us_per_row_p95", 0.95).alias("p95_near"))
    return checked.select("mode", "log_batches", "instances", "median_near", "p95_near")
