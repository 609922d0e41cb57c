"""All queries by name, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pagewright.plans import geometry_queries, html_queries, io_queries, lexicon_queries, page_queries, rule_queries, state_queries, structure, style_queries, table_queries, text_queries  # noqa: F401
from pagewright.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "txt_structure"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
