"""Every operator as a named query over the provided tables, with its SQL counterpart."""

from __future__ import annotations

from cohortry.catalog import aggregates, composed, joins, landing, learning, projections, scalars  # noqa: F401
from cohortry.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
