"""The registry of queries with their oracle SQL."""

from __future__ import annotations

from quire.plans import assembly, blocks, ordered, service, tables, texts  # noqa: F401  they register their queries
from quire.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
