"""Equality search on tokens.  A term is tokenized once, on the driver, and becomes a plan literal that
reaches the file scan; order and patterns mean nothing on tokens and are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fpe
from ..functions.keys import TokenKey
from .tokens import element_of_column


def token_predicate(
    column: str, operator: str, terms, name: str | None = None, key: TokenKey | None = None
) -> Column:
    """``column = term`` or ``column IN terms`` on a tokenized column.  The terms become part of the plan; a list
    that would grow with the data belongs in a table, for :func:`search_terms`."""
    name = name or element_of_column(column)
    if operator == "=":
        return F.col(column) == F.lit(fpe.token_of(terms, name, key))
    if operator.lower() == "in":
        return F.col(column).isin([fpe.token_of(t, name, key) for t in terms])
    raise ValueError(f"{operator!r} is not valid on tokens; only = and IN are")


def search_term(df: DataFrame, column: str, term: str, key: TokenKey | None = None) -> DataFrame:
    return df.filter(token_predicate(column, "=", term, key=key))


def search_token(df: DataFrame, column: str, token: str) -> DataFrame:
    """The caller already holds the token: no key, no function call."""
    return df.filter(F.col(column) == F.lit(token))


def search_terms(df: DataFrame, column: str, terms: DataFrame, term_column: str, key: TokenKey | None = None, name: str | None = None) -> DataFrame:
    """Any number of clear terms: tokenize the term table, then semi join.  Catalyst broadcasts the terms
    when they are small and shuffles otherwise."""
    wanted = terms.select(fpe.encrypt(term_column, name or element_of_column(column), key).alias(column))
    return df.join(wanted, column, "left_semi")


def search_decrypted(df: DataFrame, column: str, term: str, key: TokenKey | None = None) -> DataFrame:
    """Decrypt every row and compare; kept as the comparison for :func:`search_term`."""
    return df.filter(fpe.decrypt(column, element_of_column(column), key) == F.lit(term))
