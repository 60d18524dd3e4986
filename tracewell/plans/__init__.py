"""Registered queries: QUERIES by name, and SQL where it can express one."""

from . import datasets, extra, scoring, streams, telemetry  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
