"""Query keys over the driver's tables and their DuckDB equivalents. LITERAL and its SQL are checks over rows written out by hand,
which tests run; they read no table and are no queries."""

from loam.plans import chunk_queries, corpus_queries, derived_queries, literal_queries, retrieval_queries, store_queries

_HELD = (retrieval_queries, corpus_queries, chunk_queries, store_queries, derived_queries)
QUERIES = {k: v for m in _HELD for k, v in m.Q.items()}
ORACLE_SQL = {k: v for m in _HELD for k, v in m.SQL.items()}
LITERAL, LITERAL_SQL = literal_queries.Q, literal_queries.SQL
