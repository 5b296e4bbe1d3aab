"""Named queries over the given tables."""

from . import (  # noqa: F401  (importing registers the queries)
    access_queries,
    feed_queries,
    measurement_queries,
    service_queries,
    text_queries,
    token_queries,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
