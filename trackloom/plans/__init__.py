"""All registered queries over the telemetry operators."""

from trackloom.plans import check_queries, serving_queries, trip_queries
from trackloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "check_queries", "serving_queries", "trip_queries"]
