"""Every query, by importing the modules that register them."""

from ripplework.plans import activity, code, content, linkage, reports, stored  # noqa: F401
from ripplework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
