"""Queries of the numbered problems of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from gitsift.plans.registry import Registry

R = Registry()

from gitsift.llm import queries_counts, queries_names, queries_texts  # noqa: E402,F401  they register their queries
