"""All queries of the conversation engine, each with the SQL that states its result."""

from __future__ import annotations

from colloquy.plans import conversation, curation, jobs, modelling  # noqa: F401
from colloquy.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
