import pytest

from docspark.catalog import ORACLE, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf):
    assert differences(spark, sf, QUERIES[name], ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
