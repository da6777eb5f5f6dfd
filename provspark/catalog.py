"""The registered queries of the engine and the SQL that they equal."""

from __future__ import annotations

from provspark.plans import artifacts, formats, relational  # noqa: F401  they register their queries
from provspark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
