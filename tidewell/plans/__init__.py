"""Queries of the engine and the SQL that they are held against."""

from tidewell.plans import catalog, live

__all__ = ["catalog", "live"]
