"""All registered queries."""

from limnos.plans import chemistry, exchange, geometry, quality, temporal  # noqa: F401
from limnos.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
