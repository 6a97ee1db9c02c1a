"""The operators applied to the driver's tables, each with its DuckDB counterpart."""
