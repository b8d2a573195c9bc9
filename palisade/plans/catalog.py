"""All registered queries; importing the modules registers them."""

from palisade.plans import code_queries, document_queries, event_queries, flow_queries, project_queries, review_queries, stream_queries, table_queries  # noqa: F401
from palisade.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
