"""All queries of the library and their SQL."""

from . import condition_queries, detection_queries, edit_queries, page_queries, queries, scoring_queries, set_queries, wiring_queries  # noqa: F401  they register their queries

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
