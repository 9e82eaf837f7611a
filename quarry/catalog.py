"""All queries of the engine's operators, and their SQL."""

from .plans import base, canonical, code, fulltext, graphbuild, graphs, records, relational, retrieval, rules, search, streams, texts  # noqa: F401  (modules register their queries)

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
