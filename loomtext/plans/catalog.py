"""All queries of the library."""

from __future__ import annotations

from loomtext.plans import corpus, feed, names, ordered, pages, timeline  # noqa: F401  they register their queries
from loomtext.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
