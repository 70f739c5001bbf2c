"""All queries of the library by name."""

from __future__ import annotations

from barlume.plans import q_book, q_enrich, q_fold, q_import, q_metrics, q_replay, q_rows, q_series, q_store, q_stream  # noqa: F401  (they register)
from barlume.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
