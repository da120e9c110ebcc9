"""Every registered planning query against its SQL on the smallest tables."""

import pytest
from compare import differences

from partlake.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        assert differences(spark, query, sql, SMALL) == ""
    else:
        assert query(spark, SMALL).schema.fields
