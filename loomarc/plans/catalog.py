"""All queries of the core, with their DuckDB counterparts."""

from loomarc.plans import nested_queries, run_queries, text_queries

FLAGSHIP = "eligible_summary"
QUERIES = {**nested_queries.QUERIES, **text_queries.QUERIES, **run_queries.QUERIES}
ORACLE = {**nested_queries.ORACLE, **text_queries.ORACLE, **run_queries.ORACLE}
