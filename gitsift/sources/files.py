"""Sources and sinks: commit tables, reference lists, repository logs, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows stored as Parquet."""
    return spark.read.parquet(path)


def read_popular(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(ecosystem, name) from one JSON file per ecosystem, ``{"packages": [...]}``; a missing or broken file lists nothing."""
    out = spark.createDataFrame([], "ecosystem string, name string")
    for eco, path in sorted(paths.items()):
        try:
            rows = spark.read.schema("packages array<string>").option("multiLine", True).json(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(rows.select(F.lit(eco).alias("ecosystem"), F.explode("packages").alias("name")))
    return out


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain) from a text file with one domain a line; blank lines and lines of # are skipped."""
    d = F.lower(F.trim("value"))
    return spark.read.text(path).select(d.alias("domain")).where((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()


def flat(results: DataFrame) -> DataFrame:
    """The lists of reasons as text, joined by `` | ``."""
    return results.withColumns({c: F.array_join(c, " | ") for c in ("top_reasons", "top_reasons_explained")})


def write_results(results: DataFrame, path: str) -> None:
    """Tab-separated files with a header; lists are joined by `` | ``."""
    flat(results).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def report_lines(results: DataFrame) -> DataFrame:
    """The report as lines, in order: per repository a line of totals, then per flagged commit, latest first, a line with short sha,
    author (padded to 30 characters, never cut) and score, and one line for each of its first three reasons.

    A repository without flagged commits has its line of totals only; no results: no lines.
    """
    flagged = F.col("decision") == "Unusual"
    head = flagged_counts(results).select(
        "repo", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("ord"),
        F.format_string("%s: %d commits scored, %d flagged Unusual", "repo", "scored", "flagged").alias("line"),
    )
    email = F.concat("email", F.repeat(F.lit(" "), F.greatest(F.lit(30) - F.length("email"), F.lit(0))))
    first = F.format_string("  %s  %s score=%.3f", F.col("sha"), email, F.col("decision_val"))
    told = F.transform(F.slice("top_reasons_explained", 1, 3), lambda r: F.concat(F.lit("      - "), r))
    body = results.where(flagged).select("repo", "seq", F.posexplode(F.concat(F.array(first), told)).alias("ord", "line"))
    return head.unionByName(body).orderBy("repo", F.col("seq").desc_nulls_first(), "ord").select("repo", "line")


def flagged_counts(results: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("decision") == "Unusual").alias("flagged"))
