"""All registered queries: importing a module registers what it has."""

from touchline.plans import assembly_queries, boundary_queries, context_queries, detection_queries, more_queries, review_queries, run_queries, view_queries  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
