"""All registered queries of the records engine, with the SQL that gives the same rows."""

from quorumlake.plans import file_blocks, file_queries, further_queries, more_queries, place_queries, remaining_queries  # noqa: F401  register their queries
from quorumlake.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "search_documents"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
