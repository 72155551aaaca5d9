"""Named queries: importing this package registers all of them."""

from loomstone.plans import search, series, stores, tables
from loomstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "search", "series", "stores", "tables"]
