"""Registered queries: each operator over the driver's tables or views of them, with SQL for DuckDB."""
