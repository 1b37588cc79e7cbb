"""Every registered query of the engine against its SQL."""

import pytest

from relevance_spark.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, compare):
    compare(catalog.queries()[name], SQL.get(name))
