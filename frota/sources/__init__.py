"""Schemas, readers, writers and table-level access."""
