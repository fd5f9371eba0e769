"""All registered queries."""

from __future__ import annotations

from dossierlake.plans import metric_queries, rule_queries, text_queries, record_queries, document_queries, basic_queries, sheet_queries, stored_queries, box_queries, kind_queries  # noqa: F401  registers
from dossierlake.plans._registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
