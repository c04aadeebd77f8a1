"""Registered queries of the timeline engine."""

from __future__ import annotations

from tidemark.plans import flows, media, profiles, rules, signals, texts, timeline  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
