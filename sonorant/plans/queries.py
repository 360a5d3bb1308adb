"""The query catalogue over the test tables, each query with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from sonorant.plans import signal_queries, word_queries
from sonorant.plans.catalogue import ORACLES, QUERIES

word_ranges_merged = word_queries.word_ranges_merged

__all__ = ["ORACLES", "QUERIES", "signal_queries", "word_queries", "word_ranges_merged"]
