"""All registered queries of the core."""

from quillstone.plans import collection_queries, dashboard_queries, file_queries, text_queries  # noqa: F401 - they register their queries
from quillstone.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
