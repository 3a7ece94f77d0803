"""The registered queries and their SQL."""

from . import cell_queries, document_queries, report_queries, rule_queries, run_queries  # noqa: F401  (they register their queries)
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
