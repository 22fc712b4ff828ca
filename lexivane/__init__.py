"""Semantic corpus search as Spark jobs."""

from lexivane.options import Options

__all__ = ["Options"]
