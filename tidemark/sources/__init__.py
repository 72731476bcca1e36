"""Schemas, readers, writers and staging."""
