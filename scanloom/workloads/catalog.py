"""All registered queries."""

from scanloom.workloads import (  # noqa: F401  (import registers)
    chunk_queries, finding_queries, history_queries, inventory_queries, scan_queries,
)
from scanloom.workloads.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
