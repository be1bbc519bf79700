"""All registered queries."""

from tidewire.plans import io_queries, model_queries, news_queries, price_queries, text_queries  # noqa: F401
from tidewire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
