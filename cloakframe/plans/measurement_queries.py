"""Queries over repeated measurements, which line items and orders stand in for.

A line item is one run: phase = return flag, configuration = line number and status, rps = price; every
fifth order is a sentinel re-run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as ex
from ..sources.tables import table
from .base import query
from .service_queries import _median_sql

_RUNS = """runs AS (SELECT l_returnflag AS phase, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus || '-' || l_linenumber END AS config,
    'cpu_r' || CAST(l_quantity AS INTEGER) || '_b' || (l_suppkey % 3) AS function, 'W' || (l_suppkey % 4) AS workload,
    l_extendedprice AS rps, CASE WHEN l_orderkey % 5 = 0 THEN true WHEN l_orderkey % 5 = 1 THEN NULL ELSE false END AS sentinel,
    CASE WHEN l_linenumber <> 3 THEN l_tax END AS cpu_share_median, l_discount * 1000 AS us_per_row_median,
    l_quantity / 7 AS cpu_us_per_row_median FROM lineitem)"""


def runs(spark, folder):
    fifth = F.col("l_orderkey") % 5
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("phase"),
        F.when(F.col("l_linenumber") != 7, F.concat_ws("-", "l_linestatus", "l_linenumber")).alias("config"),
        F.concat(F.lit("cpu_r"), F.col("l_quantity").cast("int"), F.lit("_b"), F.col("l_suppkey") % 3).alias("function"),
        F.concat(F.lit("W"), F.col("l_suppkey") % 4).alias("workload"),
        F.col("l_extendedprice").alias("rps"),
        F.when(fifth == 0, True).when(fifth == 1, F.lit(None)).otherwise(False).alias("sentinel"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("cpu_share_median"),
        (F.col("l_discount") * 1000).alias("us_per_row_median"),
        (F.col("l_quantity") / 7).alias("cpu_us_per_row_median"),
    )


@query(
    f"""WITH {_RUNS} SELECT phase, config, count(*) AS n, {_median_sql('rps')} AS rps_median,
    {_median_sql('cpu_share_median')} AS cpu_share_median_median FROM runs GROUP BY phase, config"""
)
def medians_by_group(spark, folder):
    return ex.median_by(runs(spark, folder), ["phase", "config"], ["rps", "cpu_share_median"])


_SPREAD = f"""count(*) AS n, min(rps) AS min, max(rps) AS max, {_median_sql('rps')} AS median,
    CASE WHEN min(rps) = 0 THEN CAST('inf' AS DOUBLE) ELSE max(rps) / min(rps) END AS spread"""


@query(f"WITH {_RUNS} SELECT workload, {_SPREAD} FROM runs GROUP BY workload")
def spread_by_group(spark, folder):
    return ex.spread_by(runs(spark, folder), ["workload"])


@query(
    """SELECT o_orderpriority, scale, count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max
    FROM (SELECT o_orderpriority, unnest([-40, 0, 40]) AS scale, CAST(o_custkey AS DOUBLE) AS key FROM orders)
      CROSS JOIN LATERAL (SELECT key * pow(2.0, scale) AS v) GROUP BY o_orderpriority, scale"""
)
def mean_by_group(spark, folder):
    """Means of values around 1e-11, 1e1 and 1e14 and beyond, exactly representable, so that no sum rounds."""
    scale = F.explode(F.array(*[F.lit(s) for s in (-40, 0, 40)])).alias("scale")
    keys = table(spark, folder, "orders").select("o_orderpriority", "o_custkey", scale)
    sized = keys.withColumn("v", F.col("o_custkey") * F.pow(F.lit(2.0), "scale"))
    return ex.mean_by(sized, ["o_orderpriority", "scale"], "v")


_RANKED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY median DESC, config NULLS FIRST) AS rank FROM
      (SELECT phase, config, {_SPREAD} FROM runs WHERE sentinel IS NOT TRUE GROUP BY phase, config)),
    judged AS (SELECT placed.*, CASE WHEN placed.rank = 1 THEN 'best' WHEN placed.max < best.min THEN 'slower' ELSE 'indistinguishable' END AS verdict,
      placed.median / best.median AS vs_best FROM placed JOIN placed AS best ON placed.phase = best.phase AND best.rank = 1)"""


@query(f"WITH {_RUNS}, {_RANKED} SELECT * FROM judged")
def ranked_configs(spark, folder):
    return ex.rank_configs(runs(spark, folder), ["phase"], ["config"])


@query(
    f"""WITH {_RUNS.replace("l_extendedprice AS rps", "l_extendedprice + 200000 * (l_linenumber // 3) AS rps")}, {_RANKED}
    SELECT phase, config, verdict, rank FROM judged"""
)
def ranked_apart(spark, folder):
    """Some configurations are shifted far enough to be truly slower."""
    shifted = runs(spark, folder).withColumn(
        "rps", F.col("rps") + 200_000 * F.coalesce(F.floor(F.substring("config", 3, 1).cast("int") / 3), F.lit(2))
    )
    return ex.rank_configs(shifted, ["phase"], ["config"]).select("phase", "config", "verdict", "rank")


@query(f"WITH {_RUNS}, {_RANKED} SELECT phase, coalesce(config, '') AS config, rank FROM judged WHERE verdict = 'indistinguishable'")
def tied_configs(spark, folder):
    ranking = ex.rank_configs(runs(spark, folder), ["phase"], ["config"])
    return ex.tied_with_best(ranking, ["phase"], ["config"])


@query(
    f"""WITH {_RUNS}, parted AS (SELECT phase, config, sentinel, min(rps) AS lo, max(rps) AS hi, {_median_sql('rps')} AS middle
      FROM runs WHERE sentinel IS NOT NULL GROUP BY ALL)
    SELECT f.phase, f.config, f.lo AS first_min, f.hi AS first_max, a.lo AS again_min, a.hi AS again_max, f.middle AS first_median,
      a.middle AS again_median, NOT (f.lo <= a.hi AND a.lo <= f.hi) AS drifted FROM parted AS f JOIN parted AS a
      ON f.phase = a.phase AND f.config IS NOT DISTINCT FROM a.config AND NOT f.sentinel AND a.sentinel"""
)
def drift_check(spark, folder):
    return ex.drift(runs(spark, folder), ["phase", "config"])


_FIT = f"""curve AS (SELECT phase, function, x, y FROM (SELECT phase, function, x, {_median_sql('rps')} AS y FROM
      (SELECT *, CAST(regexp_extract(function, 'cpu_r([0-9]+)_b', 1) AS BIGINT) AS x FROM runs) GROUP BY phase, function, x) WHERE y <> 0 AND x >= 4),
    slopes AS (SELECT l.phase, (r.y - l.y) / (r.x - l.x) AS s FROM curve AS l JOIN curve AS r ON l.phase = r.phase AND r.x > l.x),
    slope AS (SELECT phase, {_median_sql('s')} AS slope FROM slopes GROUP BY phase),
    rests AS (SELECT phase, function, x, y, slope, y - slope * x AS rest FROM curve JOIN slope USING (phase)),
    floors AS (SELECT phase, greatest({_median_sql('rest')}, 0) AS floor FROM rests GROUP BY phase),
    fitted AS (SELECT phase, function, x, y, slope, floor, floor + slope * x AS fit FROM rests JOIN floors USING (phase)),
    worst AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY abs(y - fit) DESC, x, function) AS place, count(*) OVER (PARTITION BY phase) AS points FROM fitted)"""


@query(f"WITH {_RUNS}, {_FIT} SELECT phase, slope, floor, points, function AS worst_point, x AS worst_x, y AS worst_y, fit AS worst_fitted FROM worst WHERE place = 1")
def theil_sen_fit(spark, folder):
    measured = runs(spark, folder).withColumn("rounds", ex.rounds_of("function"))
    return ex.theil_sen(ex.calibration_curve(measured, ["phase"], "function", "rounds", "rps"), ["phase"])


@query(
    """SELECT 'cpu_r' || CAST(o_orderkey AS BIGINT) * 100000000003 || '_b1' AS function, CAST(o_orderkey AS BIGINT) * 100000000003 AS rounds FROM orders
    UNION ALL SELECT 'cpu_r' || o_orderkey, NULL FROM orders"""
)
def long_rounds(spark, folder):
    """Rounds of twelve digits and more, and names that hold none."""
    keys = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    names = keys.select(F.concat(F.lit("cpu_r"), F.col("k") * 100_000_000_003, F.lit("_b1")).alias("function")).unionByName(
        keys.select(F.concat(F.lit("cpu_r"), "k").alias("function"))
    )
    return names.select("function", ex.rounds_of("function").alias("rounds"))


@query(
    f"""WITH {_RUNS}, {_RANKED}, beside AS (SELECT phase, config, {_median_sql('us_per_row_median')} AS us_per_row_median_median,
      {_median_sql('cpu_share_median')} AS cpu_share_median_median FROM runs WHERE sentinel IS NOT TRUE GROUP BY phase, config)
    SELECT judged.phase, judged.config, rank, us_per_row_median_median, cpu_share_median_median FROM judged JOIN beside
      ON judged.phase = beside.phase AND judged.config IS NOT DISTINCT FROM beside.config"""
)
def ranked_with_extras(spark, folder):
    """A ranking with the medians of other measures beside it."""
    extra = ["us_per_row_median", "cpu_share_median"]
    ranking = ex.rank_configs(runs(spark, folder), ["phase"], ["config"], extra=extra)
    return ranking.select("phase", "config", "rank", *[f"{e}_median" for e in extra])


@query(
    f"""WITH {_RUNS}, points AS (SELECT workload, count(*) AS n, {_median_sql('us_per_row_median')} AS us_per_row,
      {_median_sql('cpu_us_per_row_median')} AS cpu_us_per_row, {_median_sql('cpu_share_median')} AS cpu_share, {_median_sql('rps')} AS rps
      FROM runs GROUP BY workload)
    SELECT *, CASE WHEN cpu_share <= 0 THEN CAST('inf' AS DOUBLE) ELSE (1 - cpu_share) / cpu_share END AS wait_over_service FROM points"""
)
def workload_profile(spark, folder):
    return ex.profile(runs(spark, folder), ["workload"])


@query(
    """SELECT arm, count(*) AS rows, min(label) AS first_label FROM (SELECT 'O' AS arm, l_linestatus || l_returnflag AS label FROM lineitem WHERE l_linestatus = 'O'
      UNION ALL SELECT 'R', l_linestatus || l_returnflag FROM lineitem WHERE l_returnflag = 'R') GROUP BY arm"""
)
def arms_by_label(spark, folder):
    """Rows split by a marker in their label; a label with both markers is in both arms."""
    labelled = table(spark, folder, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("label"))
    arms = ex.split_by_label(labelled, "label", {"O": "O", "R": "R"})
    return arms.groupBy("arm").agg(F.count("*").alias("rows"), F.min("label").alias("first_label"))


_PROBES = """probes AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'equivalence' WHEN 1 THEN NULL ELSE 'search' END AS probe, o_orderkey AS variant,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS reply_width, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 50 END AS batch,
    o_orderstatus <> 'F' AS succeeded, o_totalprice AS elapsed_s, o_custkey AS log_batches, o_custkey * 2 AS log_rows_total,
    CAST(o_custkey AS DOUBLE) AS batch_rows_median, o_custkey % 9 AS mismatches, o_custkey AS compared, o_custkey % 9 = 0 AS equivalent,
    o_orderpriority AS priority FROM orders)"""


def probes(spark, folder):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        F.when(key % 5 == 0, "equivalence").when(key % 5 == 1, F.lit(None)).otherwise("search").alias("probe"),
        key.alias("variant"), F.when(key % 3 == 0, customer).alias("reply_width"), F.when(key % 7 != 0, customer % 50).alias("batch"),
        (F.col("o_orderstatus") != "F").alias("succeeded"), F.col("o_totalprice").alias("elapsed_s"),
        customer.alias("log_batches"), (customer * 2).alias("log_rows_total"), customer.cast("double").alias("batch_rows_median"),
        (customer % 9).alias("mismatches"), customer.alias("compared"), (customer % 9 == 0).alias("equivalent"),
        F.col("o_orderpriority").alias("priority"),
    )


@query(
    f"""WITH {_PROBES} SELECT variant, coalesce(nullif(reply_width, 0), nullif(batch, 0), 0) AS size,
    CASE WHEN succeeded THEN 'OK' ELSE 'FAILED' END AS result, elapsed_s, log_batches, log_rows_total, batch_rows_median
    FROM probes WHERE probe IS DISTINCT FROM 'equivalence'"""
)
def variant_table(spark, folder):
    return ex.variant_table(probes(spark, folder))


@query(f"WITH {_PROBES} SELECT variant, mismatches, compared, CASE WHEN equivalent THEN 'equivalent' ELSE 'NOT equivalent' END AS result FROM probes WHERE probe = 'equivalence'")
def equivalence_table(spark, folder):
    return ex.equivalence_table(probes(spark, folder))


@query(
    f"""WITH {_PROBES} SELECT priority, count(*) FILTER (WHERE succeeded) AS succeeded, count(*) AS fired,
    CAST(count(*) FILTER (WHERE succeeded) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS ratio FROM probes GROUP BY priority"""
)
def success_ratio(spark, folder):
    return ex.success_ratio(probes(spark, folder), ["priority"])


@query(
    f"""WITH {_RUNS}, complete AS (SELECT phase, config, function FROM runs WHERE sentinel IS NOT TRUE GROUP BY ALL HAVING count(*) >= 3)
    SELECT phase, config, function FROM (SELECT DISTINCT phase, config, function FROM runs) AS plan
    WHERE NOT EXISTS (SELECT 1 FROM complete AS c WHERE c.phase = plan.phase AND c.function = plan.function AND c.config IS NOT DISTINCT FROM plan.config)"""
)
def pending_cells(spark, folder):
    done = runs(spark, folder)
    return ex.pending_cells(done.select("phase", "config", "function").distinct(), done, iterations=3)


@query(
    """SELECT p_partkey, CASE WHEN cpu <= 0 THEN CASE WHEN wait <> 0 THEN CAST('inf' AS DOUBLE) ELSE 4 END ELSE 4 * (1 + wait * 1000 / cpu) END AS slots,
    CASE WHEN cpu / 1e6 + wait / 1e3 <= 0 THEN 1e9 ELSE 1.0 / (cpu / 1e6 + wait / 1e3) END AS rows_per_s
    FROM (SELECT p_partkey, CAST(p_size - 1 AS DOUBLE) AS cpu, CAST(p_partkey % 3 AS DOUBLE) AS wait FROM part)"""
)
def predicted_slots(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") - 1).cast("double").alias("cpu"), (F.col("p_partkey") % 3).cast("double").alias("wait")
    )
    return parts.select(
        "p_partkey", ex.predicted_slots(F.lit(4), F.col("cpu"), F.col("wait")).alias("slots"),
        ex.rows_per_second_per_slot(F.col("cpu"), F.col("wait")).alias("rows_per_s"),
    )


_BANDS = ", ".join(
    "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in band) + ")"
    for band in ex.DECISION_TABLE
)


@query(
    f"""WITH points AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST((l_orderkey % 101) AS DOUBLE) / 100 END AS cpu_share,
      l_quantity * l_quantity / 9 AS us_per_row FROM lineitem),
    bands(share_from, share_to, cost_from, cost_to, worker_class, workers, threads, slots, scale_first, basis) AS (VALUES {_BANDS})
    SELECT worker_class, workers, threads, slots, scale_first, basis, count(*) AS points, min(cpu_share) AS lowest_share, max(us_per_row) AS highest_cost
    FROM points LEFT JOIN bands ON cpu_share >= coalesce(share_from, -1e300) AND cpu_share < coalesce(share_to, 1e300)
      AND us_per_row >= coalesce(cost_from, -1e300) AND us_per_row < coalesce(cost_to, 1e300)
    GROUP BY worker_class, workers, threads, slots, scale_first, basis"""
)
def recommended_setup(spark, folder):
    points = table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") != 6, (F.col("l_orderkey") % 101).cast("double") / 100).alias("cpu_share"),
        (F.col("l_quantity") * F.col("l_quantity") / 9).alias("us_per_row"),
    )
    advised = ex.recommend(points)
    return advised.groupBy("worker_class", "workers", "threads", "slots", "scale_first", "basis").agg(
        F.count("*").alias("points"), F.min("cpu_share").alias("lowest_share"), F.max("us_per_row").alias("highest_cost")
    )
