"""Registered queries (one per operator family) and their SQL oracles."""

from .registry import QUERIES  # noqa: F401


def load_all() -> dict:
    """Import every query module so that all queries are registered."""
    from . import (alert_browse_queries, forecast_queries, ingest_queries,  # noqa: F401
                   review_queries, series_queries, stream_queries)
    return QUERIES
