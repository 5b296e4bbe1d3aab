"""Scans: parquet tables, CSV with a declared schema, JSON lines with a superset schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row; types come from the schema, nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


BROKEN_LINE = "broken_line"


def scan_json_lines(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str, broken: str = "fail"
) -> DataFrame:
    """JSON lines from any number of files.  Blank lines are skipped, absent keys are NULL, so records of
    different phases share one superset schema.  A line that is no such record ends the job, or with
    ``broken="keep"`` is a row of NULLs that holds it in the column ``broken_line``."""
    if broken not in ("fail", "keep"):
        raise ValueError(f"broken must be fail or keep, got {broken!r}")
    reader = spark.read
    if broken == "fail":
        return reader.schema(schema).option("mode", "FAILFAST").json(paths)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wider = T.StructType([*fields.fields, T.StructField(BROKEN_LINE, T.StringType())])
    return reader.schema(wider).option("columnNameOfCorruptRecord", BROKEN_LINE).json(paths)


def scan_variant_lines(spark: SparkSession, paths: str | list[str], broken: str = "fail") -> DataFrame:
    """JSON lines as one column ``record`` of type VARIANT, so that records of any phase and fields that no schema names are
    all kept; blank lines are skipped.  A line that is no JSON ends the job, or with ``broken="keep"`` is a NULL
    record beside the column ``broken_line``.  Fields are read by :func:`field`."""
    if broken not in ("fail", "keep"):
        raise ValueError(f"broken must be fail or keep, got {broken!r}")
    lines = spark.read.text(paths).where(F.trim("value") != "")
    if broken == "fail":
        return lines.select(F.parse_json("value").alias("record"))
    record = F.try_parse_json("value")
    return lines.select(record.alias("record"), F.when(record.isNull(), F.col("value")).alias(BROKEN_LINE))


def field(record: Column | str, path: str, kind: str) -> Column:
    """A field of a VARIANT by its path (``a.b[0]``), NULL where it is absent or of another kind."""
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, f"$.{path}", kind)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append records; earlier files stay as they are."""
    df.write.mode("append").json(path)


def create_table_as(df: DataFrame, path: str) -> DataFrame:
    """CREATE TABLE AS SELECT into parquet; returns the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
