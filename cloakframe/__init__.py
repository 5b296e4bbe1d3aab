"""Tokenization, governed access, text privacy and service-log analytics on Spark DataFrames."""

from .session import attach

__all__ = ["attach"]
