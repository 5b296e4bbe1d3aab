"""Exact order statistics and ranks that never sort a whole group in one task.

A value's cell (a bin on a logarithmic scale) is a function of the value alone.  Counting rows per cell is
a map-side-combined aggregate with a bounded number of cells, so even a group holding a third of all rows
sends only counts.  Prefix sums over the cells name the one that holds the wanted rank; its rows are
counted again in equal slices of the cell, and only the one slice that holds the rank is counted by value.
All of it is one lazy plan: nothing runs, and nothing is written, before the caller asks for rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_E = 1024  # cells per factor of e; relative cell width about 0.1 %
SLICES = 4096
NAN_CELL = (1 << 62)  # NaN is above every number, as Spark sorts it


def cell(value: Column) -> Column:
    """Monotone cell number of a numeric value; NaN has the last cell, infinities the ones next to the ends."""
    v = value.cast("double")
    number = F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS_PER_E)
    return (
        F.when(F.isnan(v), F.lit(NAN_CELL))
        .when(F.abs(v) == float("inf"), F.when(v > 0, F.lit(NAN_CELL - 1)).otherwise(F.lit(-NAN_CELL)))
        .otherwise(number)
        .cast("long")
    )


def _right(key: str) -> str:
    return f"_right_{key}"


def _matched(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that joins them: NULL equals NULL, since a
    missing key is a group like any other."""
    renamed = right.withColumnsRenamed({k: _right(k) for k in keys})
    return renamed, reduce(and_, (F.col(k).eqNullSafe(F.col(_right(k))) for k in keys), F.lit(True))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two group tables on their keys, NULL keys included, keeping one copy of the keys."""
    renamed, condition = _matched(right, keys)
    return left.join(renamed, condition, how).drop(*[_right(k) for k in keys])


def _holding_rank(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of every group keep the row of ``order`` that contains the wanted rank, and the rank within it."""
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order)) - F.col("_n")
    return (
        counts.withColumn("_before", before)
        .filter((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
        .withColumn("_rank", F.col("_rank") - F.col("_before"))
        .drop("_before")
    )


def _slice(value: Column) -> Column:
    """Equal slices of a cell from its lowest to its highest value; a cell of one value has one slice."""
    share = F.try_divide(value.cast("double") - F.col("_lo"), F.col("_hi").cast("double") - F.col("_lo"))
    return F.coalesce(F.when(~F.isnan(share), F.floor(share * SLICES)), F.lit(0)).cast("long")


def exact_picks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """Values at given ranks of every group: columns (keys, pick, value).

    ``ranks`` maps a pick's name to its 1-based rank as SQL over the group size ``size``; a rank outside
    1..size (or NULL) yields no row.  NULL values take no part, NaN is the largest value.  ``df`` is read
    twice, so an expensive one is better stored first."""
    base = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_cell", cell(F.col("_v")))
    ends = (F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    per_cell = base.groupBy(*keys, "_cell").agg(*ends)
    sized = per_cell.withColumn("size", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(p).alias("pick"), F.expr(r).cast("long").alias("_rank")) for p, r in ranks.items()])
    )
    asked = sized.select("*", wanted.alias("_w")).select(*keys, "_cell", "_n", "_lo", "_hi", "_w.pick", "_w._rank")
    cells = _holding_rank(asked, [*keys, "pick"], "_cell").drop("_n")

    # the values of the chosen cells, counted; both steps below read the one shuffle that this takes
    within = [*keys, "pick", "_rank", "_slice"]
    by_value = _of_cells(base, cells, keys).groupBy(*within[:-1], _slice(F.col("_v")).alias("_slice"), "_v").agg(F.count("*").alias("_n"))
    per_slice = by_value.groupBy(*within).agg(F.sum("_n").alias("_n"))
    slices = _holding_rank(per_slice, [*keys, "pick"], "_slice").drop("_n")
    chosen = join_groups(by_value.drop("_rank"), slices, [*keys, "pick", "_slice"])
    return _holding_rank(chosen, [*keys, "pick"], "_v").select(*keys, "pick", F.col("_v").alias("value"))


def _of_cells(base: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in their group's chosen cells; an equality join also where there are no keys."""
    renamed, condition = _matched(cells.withColumnRenamed("_cell", "_chosen"), keys)
    return base.join(renamed, condition & (F.col("_cell") == F.col("_chosen"))).drop("_chosen", *[_right(k) for k in keys])


LOWER_MEDIAN, UPPER_MEDIAN = "(size + 1) div 2", "size div 2 + 1"


def exact_medians(df: DataFrame, keys: list[str], value: str, output: str = "median") -> DataFrame:
    """Median per group (mean of the two middle values for an even count)."""
    picks = exact_picks(df, keys, value, {"lower": LOWER_MEDIAN, "upper": UPPER_MEDIAN})
    # of two picks min is the lower and max the upper one
    middle = (F.min("value").cast("double") + F.max("value").cast("double")) / 2
    return picks.groupBy(*keys).agg(middle.alias(output))


TIE_PREFIX = 8


def _coarse(column: Column, kind: str) -> Column:
    """A coarser value in the same order: a text's first characters, a number's cell."""
    if kind == "string":
        return F.substring(column, 1, TIE_PREFIX)
    return cell(column) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else column


def ranked(df: DataFrame, keys: list[str], value: str, ties: list[str], output: str = "rank") -> DataFrame:
    """Number rows 1.. within ``keys`` by ``value`` descending, then by ``ties`` ascending.  Rows are counted by
    cell, and within a cell by value and the coarse first tie; only rows that agree in all of these are
    ordered together, so a value that very many rows share is still spread over its ties."""
    kinds = dict(df.dtypes)
    tie = _coarse(F.col(ties[0]), kinds[ties[0]]) if ties else F.lit(0)
    celled = df.withColumns({"_cell": -cell(F.col(value)), "_worth": -F.col(value), "_tie": tie})
    spot = [*keys, "_cell", "_worth", "_tie"]
    counts = celled.groupBy(*spot).agg(F.count("*").alias("_n"))
    in_cell = F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy("_worth", F.col("_tie").asc_nulls_first())) - F.col("_n")
    per_cell = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_n")
    offsets = per_cell.select(*keys, "_cell", before.alias("_before"))
    places = join_groups(counts.withColumn("_inner", in_cell).drop("_n"), offsets, [*keys, "_cell"])
    order = Window.partitionBy(*spot).orderBy(*ties) if ties else Window.partitionBy(*spot).orderBy("_worth")
    placed = join_groups(celled, places, spot)
    number = F.col("_before") + F.col("_inner") + F.row_number().over(order)
    return placed.withColumn(output, number).drop("_cell", "_worth", "_tie", "_before", "_inner")
