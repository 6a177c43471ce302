"""Imports every query module so the registry is complete."""

from __future__ import annotations

from . import q_core, q_dedup, q_gold, q_graph, q_io, q_joins, q_misc, q_ml, q_news, q_quality, q_serving, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
