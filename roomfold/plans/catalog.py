"""All registered queries."""

from roomfold.plans import algebra, clouds, floorplan, frames, matching, openings, results, rooms, sources, stitching  # noqa: F401
from roomfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
