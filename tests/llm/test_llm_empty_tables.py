"""Every query over tables without rows: no error, no rows or only the rows of the other tables."""

import glob
import os

import pytest

from gitsift.llm.queries import R


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).limit(0).coalesce(1).write.parquet(str(out / os.path.basename(path)))
    return str(out)


NAMES = list(R.queries)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty_dir, name):
    assert R.queries[name](spark, empty_dir).count() == 0
