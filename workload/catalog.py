"""All registered queries."""

from workload import review_queries, scalar_queries, source_queries, span_queries, stream_queries, visual_queries  # noqa: F401  (each registers its own)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
