"""Session helpers: table access, shared scratch tables, one row per commit."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}  # folders made for sessions on a local master, by application


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session on a local master may do without the setting; it gets a folder
    of its own. Elsewhere a missing setting is an error, as a machine's own
    temporary folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/gitsift/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    The files outlive executors. They stay until the folder is cleared, because
    the frame returned here is lazy and may be read at any later time.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """:func:`stage` for several independent frames at a time, so that their small stages share the cluster."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(zip(frames, pool.map(stage, frames.values(), frames)))


def distinct_commits(commits: DataFrame, *columns: str) -> DataFrame:
    """One row per ``sha`` with the given columns.

    A commit may be delivered many times with equal values, so any delivery
    stands for it. The shuffle is by ``sha``, of which no value is frequent; the
    frequent authors and repositories play no part in it. Rows without a ``sha``
    are no commits and are left out.
    """
    keep = [c for c in dict.fromkeys(columns) if c != "sha"]
    rows = commits.where(F.col("sha").isNotNull()).select("sha", *keep)
    return rows.dropDuplicates(["sha"])
