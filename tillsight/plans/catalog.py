"""All registered queries (importing the catalog modules fills the registry)."""

from __future__ import annotations

from tillsight.plans import catalog_base  # noqa: F401
from tillsight.plans import catalog_analytics  # noqa: F401
from tillsight.plans import catalog_streaming  # noqa: F401
from tillsight.plans.registry import ORACLE, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
