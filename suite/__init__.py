"""Registered queries: each a Spark job over the given tables and, where SQL can say it, its oracle."""

from suite import charts, cleaning, classification, describe, filters, grouping, ingest, profile, quality, report  # noqa: F401
from suite.registry import ORACLES, QUERIES  # noqa: F401
