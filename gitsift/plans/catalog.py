"""All registries of the core library."""

from __future__ import annotations

from gitsift.plans import author_queries, commit_queries, profile_queries
from gitsift.plans.registry import Registry


def registries() -> list[Registry]:
    return [author_queries.R, profile_queries.R, commit_queries.R]
