"""All registered queries of the graph library."""

from . import q_graph, q_lookup, q_more, q_rules, q_search  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
