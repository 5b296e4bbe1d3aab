"""Registry of named queries, each over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import attach
from ..sources.pii import BIRTH_DAYS, BIRTH_EPOCH, DOMAINS, FIRST_NAMES, LAST_NAMES, pii_from
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; ``sql`` is left out where SQL cannot say it."""

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(attach(spark), folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return run

    return register


def people(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data of every customer."""
    return pii_from(table(spark, folder, "customer"), "c_custkey", keep=keep)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def people_sql(source: str = "customer", key: str = "c_custkey", keep: str = "") -> str:
    """The same rows as SQL (a SELECT)."""
    return f"""
    SELECT id, first || ' ' || last AS name,
           lower(first) || '.' || lower(last) || '.' || id || '@' || domain AS email,
           (100 + (id * 7919) % 900) || '-' || (10 + (id * 104729) % 90) || '-' || (1000 + (id * 1299709) % 9000) AS ssn,
           CAST(CAST(DATE '{BIRTH_EPOCH}' + CAST((id * 613) % {BIRTH_DAYS} AS INTEGER) AS DATE) AS VARCHAR) AS dob{keep}
    FROM (SELECT *, CAST({key} AS BIGINT) AS id,
                 ({_sql_list(FIRST_NAMES)})[CAST({key} % 10 AS INTEGER) + 1] AS first,
                 ({_sql_list(LAST_NAMES)})[CAST(({key} // 10) % 10 AS INTEGER) + 1] AS last,
                 ({_sql_list(DOMAINS)})[CAST({key} % 5 AS INTEGER) + 1] AS domain
          FROM {source}) AS keyed"""


PEOPLE = f"WITH people AS ({people_sql()})"
