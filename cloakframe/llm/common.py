"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import shared_path

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator in the shared folder.  They are dropped as soon as what was made of them
    is stored, so they do not pile up; what a lazy result still reads is left for the folder's own clean-up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Store and read back; see :func:`cloakframe.session.settle`."""
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, or all."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """The ``rows`` rows (or all) of lowest key hash.  A first cut by hash keeps about twice as many, so that no task
    orders more than a few of these however many there are."""
    slots = 1 << 30
    keep = min(slots, slots * 2 * (rows + 100) // max(df.count(), 1) + 1)
    slot = F.pmod(F.xxhash64(*key), F.lit(slots))
    return df.where(slot < keep).orderBy(slot, *key).limit(rows)


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def running_total(
    df: DataFrame, group: list[str], order: list[str], value: str, into: str, bucket: Column | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group.  Rows stand in the order of ``bucket`` (else one of
    4096 hashes of ``order``) and then of ``order`` itself, so no window holds more than one bucket of one group, and only a total
    for each bucket is summed over a whole group.  Rows that agree in all of ``order`` may stand in either order;
    as they are equal, the rows returned as a set are the same in every run.  ``group`` must not be null."""
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(4096)) if bucket is None else bucket)
    key = [*group, "__bucket"]
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        bucketed.groupBy(*key)
        .agg(F.sum(value).alias("__total"))
        .select(*key, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    )
    rows = bucketed.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, on=key).select(
        *df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(into)
    )
