"""Named queries over the driver tables, each with its SQL counterpart."""

from pulsegrid.plans import aggregates, alerting, modelling, scalars, scans, streams, windows  # noqa: F401
from pulsegrid.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
