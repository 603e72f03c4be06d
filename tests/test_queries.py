import pytest

from aisleflow.plans import catalog
from oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.SQL[name], "/root/testdata/sf0.01")
