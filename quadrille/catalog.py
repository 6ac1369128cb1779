"""Every registered query of the raster, vector and learning operators, with its SQL."""

from __future__ import annotations

from .plans import learning, raster, vector, zonal  # noqa: F401
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
