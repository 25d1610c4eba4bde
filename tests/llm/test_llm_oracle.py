import pytest
from compare import check

from gitsift.llm.queries import R


@pytest.mark.parametrize("name", R.sql)
def test_query_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, R.queries[name], R.sql[name])


@pytest.mark.parametrize("name", [n for n in R.queries if n not in R.sql])
def test_query_runs(spark, sf_dir, name):
    assert R.queries[name](spark, sf_dir).count() > 0
