"""Derived tables, and the registered queries in modules that add themselves to the registry."""

from . import decisions, ingestion, registry, streams  # noqa: F401
