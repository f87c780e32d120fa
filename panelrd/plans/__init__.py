"""Query catalogue over the driver tables: table roles, Spark queries and the
matching DuckDB oracle SQL (same expressions, used for result checks)."""
