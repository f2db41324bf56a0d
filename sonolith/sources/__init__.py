"""Readers of tables and files."""

from sonolith.sources.tables import table  # noqa: F401
