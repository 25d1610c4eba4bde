"""Queries of the general problems: per-author features, and results per author under skew."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.operators.eager import eager_join_aggregate, heavy_keys, roll_up
from gitsift.operators.entity_features import BucketStore, feature_rows
from gitsift.plans.registry import Registry
from gitsift.session import distinct_commits, scratch_path, stage, table

R = Registry()

VALUES = ("gap_seconds", "churn_ratio")


LATE = 120  # days before the newest delivery, from which on deliveries are added to a store built without them


def _author_store(spark: SparkSession, sf_dir: str, values: tuple[str, ...]) -> BucketStore:
    """A store built from the earlier deliveries and brought up to date with the late ones, which change the months of their commits only."""
    store = BucketStore(scratch_path(spark, "author-buckets"), ("repo", "email"), "top_dirs", "authored_ts", "seq", values, unique="sha")
    commits = table(spark, sf_dir, "commits")
    since = commits.agg(F.max("ingested_ts") - F.expr(f"INTERVAL {LATE} DAYS")).first()[0]
    if since is None:
        return store.build(commits)
    late = F.col("ingested_ts") > F.lit(since)
    store.build(commits.where(~F.coalesce(late, F.lit(False))))
    store.update(commits, commits.where(late))
    return store


@R.query("""
WITH c AS (SELECT sha, any_value(repo) AS repo, any_value(email) AS email, any_value(seq) AS seq,
                  any_value(list_filter(list_distinct(coalesce(top_dirs, [])), lambda x: x IS NOT NULL)) AS dirs
           FROM commits WHERE sha IS NOT NULL GROUP BY sha),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, email ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY repo, email) AS n FROM c),
d AS (SELECT repo, email, unnest(dirs) AS top_dir FROM r WHERE rn > 1 OR n = 1),
b AS (SELECT repo, email, top_dir, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT repo, email, unnest(map_keys(dir_counts)) AS top_dir, unnest(map_values(dir_counts)) AS n FROM author_history)
SELECT repo, email, top_dir FROM b FULL JOIN h USING (repo, email, top_dir)
WHERE coalesce(b.n, 0) <> coalesce(h.n, 0)
""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories whose stored count differs from the one rebuilt from the bucketed aggregates."""
    keys = ["repo", "email"]
    f = _author_store(spark, sf_dir, ()).features(spark)
    whole = f.where(F.col("_type").isNull()).select(*keys, F.col("n").alias("n_all"), F.col("last_order").alias("last_all"))
    # the profile leaves the author's last commit out unless it is the only one
    own_last = (F.col("n_all") > 1) & (F.col("last_order") == F.col("last_all"))
    rebuilt = (
        f.where(F.col("_type").isNotNull())
        .join(whole, keys)
        .select(*keys, F.col("_type").alias("top_dir"), (F.col("n") - own_last.cast("long")).alias("n_rebuilt"))
    )
    stored = table(spark, sf_dir, "author_history").select(*keys, F.explode("dir_counts").alias("top_dir", "n_stored"))
    zero = F.lit(0)
    return (
        rebuilt.join(stored, [*keys, "top_dir"], "full")
        .where(F.coalesce("n_rebuilt", zero) != F.coalesce("n_stored", zero))
        .select(*keys, "top_dir")
    )


@R.query("""
WITH c AS (SELECT sha, any_value(email) AS email, any_value(authored_ts) AS ts, any_value(gap_seconds) AS gap, any_value(churn_ratio) AS churn,
                  any_value(list_filter(list_distinct(coalesce(top_dirs, [])), lambda x: x IS NOT NULL)) AS dirs
           FROM commits WHERE sha IS NOT NULL GROUP BY sha),
e AS (SELECT email, count(*) AS n_events, max(ts) AS last_ts, round(sum(gap), 3) AS sum_gap_seconds, round(sum(churn), 3) AS sum_churn_ratio FROM c GROUP BY email),
d AS (SELECT email, dir, count(*) AS n, max(ts) AS last_ts, coalesce(round(sum(gap)), 0)::BIGINT AS gap, coalesce(round(sum(churn) * 1000), 0)::BIGINT AS churn FROM (SELECT email, ts, gap, churn, unnest(dirs) AS dir FROM c) GROUP BY ALL),
l AS (SELECT email, count(*) AS n_dirs, string_agg(dir || '=' || n || '@' || epoch(last_ts)::BIGINT || ':' || gap || ':' || churn, '|' ORDER BY dir) AS dirs FROM d GROUP BY email)
SELECT email, n_events, epoch((SELECT max(ts) FROM c))::BIGINT - epoch(last_ts)::BIGINT AS recency_seconds, sum_gap_seconds, sum_churn_ratio,
       coalesce(n_dirs, 0) AS n_dirs, coalesce(dirs, '') AS dirs
FROM e LEFT JOIN l USING (email)
""")
def p2_author_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author: commits, recency, totals, and per directory ``name=count@last time:gap seconds:churn in thousandths``."""
    store = _author_store(spark, sf_dir, VALUES)
    states = store.states(spark)
    by_author = store.by(["email"]).features(spark)
    rows = feature_rows(by_author, ("email",), VALUES)
    newest = states.agg(F.unix_timestamp(F.max("last_ts")).alias("t")).scalar()
    whole = lambda x, scale: F.coalesce(F.round(x * scale).cast("long"), F.lit(0))
    one = lambda e: F.format_string(
        "%s=%d@%d:%d:%d", e["key"], e["value"]["n"], F.unix_timestamp(e["value"]["last_ts"]), whole(e["value"]["sum_gap_seconds"], 1), whole(e["value"]["sum_churn_ratio"], 1000)
    )
    return rows.select(
        "email",
        "n_events",
        (newest - F.unix_timestamp("last_ts")).alias("recency_seconds"),
        *[F.round(f"sum_{v}", 3).alias(f"sum_{v}") for v in VALUES],
        F.size("by_type").cast("long").alias("n_dirs"),
        F.array_join(F.transform(F.map_entries("by_type"), one), "|").alias("dirs"),
    )


_SPAN = """b AS (SELECT date_trunc('second', max(authored_ts)) - INTERVAL 10 DAY AS past, date_trunc('second', max(authored_ts)) - INTERVAL 210 DAY AS start FROM commits WHERE sha IS NOT NULL)"""


@R.query(f"""
WITH {_SPAN}, c AS (SELECT sha, any_value(repo) AS repo, any_value(email) AS email, any_value(authored_ts) AS ts, any_value(churn_ratio) AS churn,
                  any_value(list_filter(list_distinct(coalesce(top_dirs, [])), lambda x: x IS NOT NULL)) AS dirs
           FROM commits WHERE sha IS NOT NULL GROUP BY sha),
w AS (SELECT c.* FROM c, b WHERE ts >= start AND ts < past),
d AS (SELECT repo, email, unnest(list_append(dirs, NULL)) AS top_dir, ts, churn FROM w)
SELECT repo, email, coalesce(top_dir, '') AS top_dir, count(*) AS n, epoch(max(ts))::BIGINT AS last_time, round(sum(churn), 3) + 0 AS churn FROM d GROUP BY repo, email, d.top_dir
""")
def p2_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, last time and churn per author and directory ('' for all) of 200 days that begin and end inside a month.

    Whole months come from the store, the events of the two months that the bounds cut from the table.
    """
    commits = table(spark, sf_dir, "commits")
    end = commits.where("sha is not null").agg(F.date_trunc("second", F.max("authored_ts"))).first()[0]
    keys = ["repo", "email"]
    store = _author_store(spark, sf_dir, VALUES)
    start, past = (end - timedelta(days=210), end - timedelta(days=10)) if end else (None, None)
    f = store.features(spark, commits, start, past)
    return f.select(*keys, F.coalesce("_type", F.lit("")).alias("top_dir"), "n", F.unix_timestamp("last_ts").alias("last_time"), (F.round("sum_churn_ratio", 3) + 0).alias("churn"))


def _commits_with_documents(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    commits = distinct_commits(table(spark, sf_dir, "commits"), "email", "repo", "loc_added")
    documents = table(spark, sf_dir, "documents").select("email", "repo", "n_chars")
    return eager_join_aggregate(commits, documents, ["email", "repo"], ["loc_added"], ["n_chars"], how)


@R.query("""
WITH c AS (SELECT sha, any_value(email) AS email FROM commits WHERE sha IS NOT NULL GROUP BY sha)
SELECT email FROM c GROUP BY email HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM c)
""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails with at least 2 % of the distinct commits, from the states of commits joined to documents."""
    # one row per author, read for the total and for the authors
    per_author = stage(roll_up(_commits_with_documents(spark, sf_dir, "full"), ["email"]), "author-states")
    return heavy_keys(per_author, "n_left", 2, 100).select("email")


@R.query("""
WITH c AS (SELECT sha, any_value(email) AS email, any_value(repo) AS repo, any_value(loc_added) AS loc_added FROM commits WHERE sha IS NOT NULL GROUP BY sha)
SELECT email, count(*) AS join_rows, sum(c.loc_added)::BIGINT AS sum_loc_added_left, sum(d.n_chars)::BIGINT AS sum_n_chars_right
FROM c JOIN documents d USING (email, repo) GROUP BY email
""")
def p3_author_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per author over commits joined to documents of the same author and repository: rows and sums."""
    joined = roll_up(_commits_with_documents(spark, sf_dir, "inner"), ["email"])
    return joined.select("email", "join_rows", "sum_loc_added_left", "sum_n_chars_right")
