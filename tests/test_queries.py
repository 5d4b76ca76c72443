import pytest

from lodestone import queries as core
from oracle import assert_same

FOLDER = "/root/testdata/sf0.001"
@pytest.mark.parametrize("name", sorted(set(core.oracle_sql())))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, FOLDER, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", ["review_aspects", "balanced_business_selection"])
def test_rows_only_queries_run(spark, name):
    assert core.queries()[name](spark, FOLDER).count() > 0
