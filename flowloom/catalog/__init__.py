"""All registered queries, one module per operator family."""

from flowloom.catalog.base import REGISTRY
from flowloom.catalog import adhoc, anomalies, ingest, live, profiles, reports, security, traffic  # noqa: F401

__all__ = ["REGISTRY"]
