"""The registered queries and their oracle SQL."""

from quillon.plans import cluster_queries, density_queries, event_pipeline, filter_queries, graph_queries, item_queries, match_queries, model_queries, name_queries, place_queries, source_queries  # noqa: F401
from quillon.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
