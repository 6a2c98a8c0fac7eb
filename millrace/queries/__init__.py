"""Registered queries; importing the modules fills the registry."""

from millrace.queries import aggregates, changes, facts, flagged, jobs, logsplit, streams  # noqa: F401
from millrace.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
