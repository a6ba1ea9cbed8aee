"""Registered queries: each operator applied to whole tables, with its SQL twin."""

from __future__ import annotations

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401  (importing registers the queries)
    area_queries,
    cleaning_queries,
    model_queries,
    pixel_queries,
    point_queries,
    rain_queries,
    report_queries,
    surface_queries,
)
