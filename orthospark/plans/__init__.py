"""Registered queries and the SQL that each is held against."""

from . import catalog_queries, lake_queries, raster_queries, spatial_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
