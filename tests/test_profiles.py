import re

from pyspark.sql import functions as F

from gitsift.operators import profiles as P
from gitsift.operators.detect import NARROW
from gitsift.session import distinct_commits, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_authors_stay_spread(spark, sf_dir):
    """Without broadcasts, no join gathers commits by author alone, and the aggregate by author combines before its own shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        commits = distinct_commits(table(spark, sf_dir, "commits"), *NARROW)
        authors = commits.select("repo", "email").distinct()
        for df in (P.author_profiles(commits), P.directory_counts(commits), P.author_profiles(P.of_authors(commits, authors))):
            text = plan(df)
            joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", text)
            assert joins and all("seq" in j or "_part" in j for j in joins)
            assert re.search(r"hashpartitioning\(repo#\d+, email#\d+(, top_dir#\d+)?, \d+\)", text) and "partial_count" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_last_commit_is_left_out_unless_it_is_the_only_one(spark):
    rows = [("r", "a", 1), ("r", "a", 5), ("r", "a", 3), ("r", "b", 2), ("s", "a", 9), (None, "x", 4), (None, "x", 6)]
    df = spark.createDataFrame([(*x, f"sha{k}", 0) for k, x in enumerate(rows)], "repo string, email string, seq long, sha string, _n int")
    assert {(r.repo, r.email, r.seq) for r in P.without_last(df.drop("_n")).collect() if r.repo} == {("r", "a", 1), ("r", "a", 3), ("r", "b", 2), ("s", "a", 9)}
    assert P.without_last(df.where("false")).count() == 0


def test_commits_of_authors(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("sha"), F.lit("r").alias("repo"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id"))).alias("email"))
    some = spark.createDataFrame([("r", "hot"), ("r", "a7"), ("q", "a8"), ("r", None)], "repo string, email string")
    got = P.of_authors(df, some).groupBy("email").count().collect()
    assert {tuple(r) for r in got} == {("hot", 334), ("a7", 1)}


def test_type_statistics(spark):
    rows = [("r", [".a", ".b", ".a"]), ("r", [".a"]), ("r", None), ("r", []), ("s", [None, ".c"])]
    stats = P.type_statistics(spark.createDataFrame(rows, "repo string, filetypes array<string>"), ["repo"]).cache()
    assert {(r.repo, r.a, r.b, r.n, r.n_files) for r in stats.collect()} == {("r", None, None, 4, None), ("r", ".a", None, 2, 3), ("r", ".b", None, 1, 1), ("r", ".a", ".b", 1, None), ("s", None, None, 1, None), ("s", ".c", None, 1, 1)}
    assert {(r.filetype, r.pct, r.freq) for r in P.type_shares(stats, ["repo"]).collect()} == {(".a", 75.0, 0.5), (".b", 25.0, 0.25), (".c", 100.0, 1.0)}
    assert [(r.a, r.b, r.freq) for r in P.pair_shares(stats, ["repo"]).collect()] == [(".a", ".b", 0.25)]
