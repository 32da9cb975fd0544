"""Every query of the engine, by name, and the SQL each is held against."""

from __future__ import annotations

from millrace.plans import chat, corpus, evaluation, numbers, operations, ordering, stream  # noqa: F401  each registers its queries
from millrace.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
