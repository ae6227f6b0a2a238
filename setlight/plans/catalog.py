"""All queries of the analytics part, by name."""

from . import q_concerts, q_enrichment, q_functions, q_links, q_listening, q_order, q_sets, q_sources, q_views  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
