"""All queries of the core and their SQL."""

from __future__ import annotations

from quern.plans import q_converse, q_entities, q_ingest, q_retrieve  # noqa: F401  (they register their queries)
from quern.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
