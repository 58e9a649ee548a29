"""All named queries."""

from pulse.plans import log_queries, post_queries, stream_queries, text_queries, trend_queries, view_queries  # noqa: F401
from pulse.plans.registry import QUERIES

__all__ = ["QUERIES"]
