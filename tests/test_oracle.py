import pytest
from compare import check

from gitsift.plans.catalog import registries

NAMES = [(r, n) for r in registries() for n in r.sql]


@pytest.mark.parametrize("registry,name", NAMES, ids=[n for _, n in NAMES])
def test_query_matches_sql(spark, sf_dir, registry, name):
    check(spark, sf_dir, registry.queries[name], registry.sql[name])


NO_SQL = [(r, n) for r in registries() for n in r.queries if n not in r.sql]


@pytest.mark.parametrize("registry,name", NO_SQL, ids=[n for _, n in NO_SQL])
def test_query_runs(spark, sf_dir, registry, name):
    assert registry.queries[name](spark, sf_dir).count() > 0
