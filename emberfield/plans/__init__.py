"""Registered queries over the given tables."""

from emberfield.plans import detector, geometry, intake, matching, reports, streams, views
from emberfield.plans.catalog import CATALOG

__all__ = ["CATALOG", "detector", "geometry", "intake", "matching", "reports", "streams", "views"]
