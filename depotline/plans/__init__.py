"""Query registry and the DuckDB oracle used to check it."""
