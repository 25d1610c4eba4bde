"""Every query over tables without rows: no error, no rows or only the rows of the other tables."""

import glob
import os

import pytest

from gitsift.plans.catalog import registries


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).limit(0).coalesce(1).write.parquet(str(out / os.path.basename(path)))
    return str(out)


NAMES = [(r, n) for r in registries() for n in r.queries]


@pytest.mark.parametrize("registry,name", NAMES, ids=[n for _, n in NAMES])
def test_empty(spark, empty_dir, registry, name):
    assert registry.queries[name](spark, empty_dir).count() == 0
