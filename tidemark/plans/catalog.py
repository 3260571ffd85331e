"""Importing this module registers all queries."""

from tidemark.plans import aggregates, analytics, columns, filters, inventory, joins, logs, scans, streams, windows  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
