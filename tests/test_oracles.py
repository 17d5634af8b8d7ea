"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from glyphmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(name, spark, sf, duck, same_rows):
    assert same_rows(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    assert len(catalog.QUERIES[name](spark, sf).toPandas()) > 0
