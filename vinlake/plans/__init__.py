"""Whole queries over the domain's tables."""

from vinlake.plans import catalog, control, history, imports, ingest, search, streams, usage  # noqa: F401  each registers its queries
from vinlake.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
