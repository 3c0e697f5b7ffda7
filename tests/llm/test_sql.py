from __future__ import annotations

import pytest

from quern.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    assert oracle.spark_rows(queries.queries()[name](spark, sf_dir)) == oracle.sql_rows(con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir)
    if name.endswith("_found"):
        assert rows.count() == rows.distinct().count()
    else:
        assert rows.count() > 0
