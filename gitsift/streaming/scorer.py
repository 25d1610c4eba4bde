"""Streaming: late, repeated commits in; deduplicated counts and simple alerts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.functions import scoring as S


DELAY = "200 days"  # deliveries come late and again by up to some months


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file."""
    head, tail = path[:-1], path[-1]
    return spark.readStream.schema(schema).parquet(f"{head}[{tail}]")  # as a pattern the path may also name a single file


def first_deliveries(commits: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each commit once, however often it is delivered within ``delay`` of its first delivery.

    The state holds the commits of the last ``delay`` only. A row whose ``ingested_ts`` is more than ``delay`` behind the newest of the batches before
    is dropped, so ``delay`` has to exceed the real lateness of the files.
    """
    return commits.withWatermark("ingested_ts", delay).dropDuplicatesWithinWatermark(["sha"])


def daily_activity(commits: DataFrame, delay: str = DELAY) -> DataFrame:
    """Distinct commits and lines per repository, author and day of delivery; the state of a day is dropped ``delay`` after it.

    A commit delivered again within ``delay`` counts once, on the day that it came first; see :func:`first_deliveries` for what comes later still.
    """
    day = F.window("ingested_ts", "1 day")
    return first_deliveries(commits, delay).groupBy(day.alias("day"), "repo", "email").agg(F.count(F.lit(1)).alias("n_commits"), F.sum("total_loc").alias("total_loc"))


def by_day(activity: DataFrame) -> DataFrame:
    """From the stored rows of :func:`daily_activity`, per day and repository: commits, lines and the exact number of authors."""
    return activity.groupBy("day", "repo").agg(F.sum("n_commits").alias("n_commits"), F.sum("total_loc").alias("total_loc"), F.count(F.lit(1)).alias("n_authors"))


def tail_alerts(commits: DataFrame, fits: DataFrame, metric: str = "total_loc", least: float = 0.99) -> DataFrame:
    """Commits of a stream that lie in the fitted tail of their repository. ``fits``: repo, alpha, beta (static, one row per repository)."""
    rarity = S.tail_rarity(F.col(metric), F.col("alpha"), F.col("beta"))
    return commits.join(fits.select("repo", "alpha", "beta"), "repo").withColumn("rarity", rarity).where(F.col("rarity") >= least).select("sha", "repo", "email", metric, "rarity")
