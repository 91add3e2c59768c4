"""Registered queries. Each module puts a query next to the SQL text that checks it."""

from gridloom.plans import (  # noqa: F401  (importing registers the queries)
    aggregates,
    brickwork,
    expressions,
    pairing,
    placement,
    scans,
    streams,
    tomography,
    userfns,
)
from gridloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
