"""Palimpsest: analytics over versioned, cross-referenced document corpora on Spark."""

from palimpsest.session import get_session, load_table

__all__ = ["get_session", "load_table"]
