"""Every query of the core against its SQL, on whole small tables."""

from __future__ import annotations

import pytest

from quern.plans import catalogue
from tests import oracle

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    got = oracle.spark_rows(catalogue.queries()[name](spark, sf_dir))
    assert name in catalogue.oracle_sql(), "every query of the core has SQL"
    assert got == oracle.sql_rows(con, catalogue.oracle_sql()[name])


def test_entry_has_stable_columns(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "chunk_index", "preview", "hits"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
