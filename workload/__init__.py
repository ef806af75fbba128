"""Registered queries over the driver tables, each next to the DuckDB statement that must agree with it."""
