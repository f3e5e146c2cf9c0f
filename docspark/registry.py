"""All queries of the library by name, with DuckDB SQL for those that SQL can express."""

from docspark.plans import case_queries, more_queries, name_queries, recall_queries, row_queries  # noqa: F401  (registers their queries)
from docspark.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
