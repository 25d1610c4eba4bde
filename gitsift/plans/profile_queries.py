"""Queries over the distributions of repositories and authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.functions import scoring as S
from gitsift.operators import profiles as P
from gitsift.operators.detect import NARROW, latest
from gitsift.plans.registry import Registry
from gitsift.session import distinct_commits, stage, table

R = Registry()

# One row per commit, for all SQL below.
C = """c AS (SELECT sha, any_value(repo) AS repo, any_value(email) AS email, any_value(seq) AS seq, any_value(total_loc) AS total_loc, any_value(loc_added) AS loc_added,
  any_value(loc_removed) AS loc_removed, any_value(files_changed) AS files_changed, any_value(files_added) AS files_added, any_value(files_removed) AS files_removed,
  any_value(commit_msg_words) AS commit_msg_words, any_value(hour_utc) AS hour_utc, any_value(weekday_utc) AS weekday_utc, any_value(filetypes) AS filetypes, any_value(top_dirs) AS top_dirs,
  any_value(gpg_signed) AS gpg_signed, any_value(author_committer_mismatch) AS mismatch, any_value(gap_seconds) AS gap_seconds, any_value(commit_delay_seconds) AS commit_delay_seconds,
  any_value(churn_ratio) AS churn_ratio, any_value(message) AS message, any_value(new_deps) AS new_deps, any_value(changed_deps) AS changed_deps FROM commits WHERE sha IS NOT NULL GROUP BY sha)"""
# The same without the author's last commit.
PROFILE = """k AS (SELECT *, max(seq) OVER (PARTITION BY repo, email) AS last_seq, count(*) OVER (PARTITION BY repo, email) AS author_n FROM c),
  prof AS (SELECT * FROM k WHERE seq <> last_seq OR author_n = 1)"""
LONG = "u AS (UNPIVOT (SELECT repo, email, sha, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in P.METRICS) + " FROM c) ON " + ", ".join(P.METRICS) + " INTO NAME metric VALUE x)"


def _fits(keys: str, tag: str = "") -> str:
    s, e, d, f, fit = (x + tag for x in ("s", "e", "d", "f", "fit"))
    return f"""{s} AS (SELECT {keys}, metric, x FROM u),
  {e} AS (SELECT {keys}, metric, x FROM {s} UNION ALL SELECT {keys}, metric, max(x) + 1 FROM {s} GROUP BY {keys}, metric HAVING min(x) = max(x)),
  {d} AS (SELECT *, cume_dist() OVER (PARTITION BY {keys}, metric ORDER BY x) AS ecdf FROM {e}),
  {f} AS (SELECT {keys}, metric, -regr_slope(ln(1 + 1e-6 - ecdf), ln(x + 1e-6)) AS beta, regr_intercept(ln(1 + 1e-6 - ecdf), ln(x + 1e-6)) AS icpt FROM {d} GROUP BY {keys}, metric),
  {fit} AS (SELECT {keys}, metric, CASE WHEN beta = 0 THEN 0 ELSE exp(icpt / beta) END AS alpha, beta FROM {f})"""


def _commits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return distinct_commits(table(spark, sf_dir, "commits"), *columns)


def _rounded(fits: DataFrame) -> DataFrame:
    return fits.withColumns({"alpha": F.round(F.log(F.col("alpha") + 1), 4), "beta": F.round("beta", 5)})


@R.query(f"WITH {C}, {LONG}, {_fits('repo')} SELECT repo, metric, round(ln(alpha + 1), 4) AS alpha, round(beta, 5) AS beta FROM fit")
def global_tail_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail fit of each size metric of each repository (alpha as ln(alpha + 1))."""
    values = P.metric_values(_commits(spark, sf_dir, "repo", *P.METRICS), ["repo"])
    return _rounded(P.tail_fits(values, ["repo", "metric"]))


@R.query(f"WITH {C}, {LONG}, {_fits('repo, email')} SELECT repo, email, metric, round(ln(alpha + 1), 4) AS alpha, round(beta, 5) AS beta FROM fit")
def author_tail_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail fit of each size metric of each author."""
    values = P.metric_values(_commits(spark, sf_dir, "repo", "email", *P.METRICS), ["repo", "email"])
    return _rounded(P.tail_fits(values, ["repo", "email", "metric"]))


@R.query(f"""WITH {C}, {LONG}, {_fits('repo')}
SELECT sha, metric, round(greatest(0, 1 - power(alpha / x, beta)), 5) AS rarity FROM u JOIN fit USING (repo, metric) WHERE x <> 0
UNION ALL SELECT sha, metric, 0 FROM u WHERE x = 0""")
def metric_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail rarity of every commit and size metric within its repository."""
    commits = _commits(spark, sf_dir, "repo", *P.METRICS)
    fits = P.tail_fits(P.metric_values(commits, ["repo"]), ["repo", "metric"])
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in P.METRICS)
    long = commits.selectExpr("sha", "repo", f"stack({len(P.METRICS)}, {pairs}) as (metric, value)").where("value is not null")
    return long.join(fits, ["repo", "metric"]).select("sha", "metric", F.round(S.tail_rarity(F.col("value"), F.col("alpha"), F.col("beta")), 5).alias("rarity"))


def _circular_sql(column: str, period: int) -> str:
    kernel = f"exp(4 * cos(2 * pi() * (g.q - h.v) / {period}))"
    return f"""WITH {C}, {PROFILE}, h AS (SELECT repo, email, {column} AS v, count(*) AS n FROM prof GROUP BY ALL),
    g AS (SELECT unnest(range({period})) AS q), dens AS (SELECT repo, email, q, sum(n * {kernel}) AS d FROM h, g GROUP BY ALL),
    top AS (SELECT repo, email, max(d) AS m FROM dens GROUP BY ALL)
    SELECT c.sha, round(1 - dens.d / top.m, 6) AS rarity FROM c JOIN dens ON c.repo = dens.repo AND c.email = dens.email AND c.{column} = dens.q JOIN top ON top.repo = c.repo AND top.email = c.email"""


def _circular(spark: SparkSession, sf_dir: str, column: str, hist: str, period: int) -> DataFrame:
    commits = _commits(spark, sf_dir, *NARROW)
    density = P.author_profiles(commits).select("repo", "email", S.circular_density(F.col(hist), period).alias("density"))
    return commits.join(density, ["repo", "email"]).select("sha", F.round(S.circular_rarity(F.col(column), F.col("density")), 6).alias("rarity"))


@R.query(_circular_sql("hour_utc", 24))
def hour_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rare a commit's hour is for its author, on the circle of hours."""
    return _circular(spark, sf_dir, "hour_utc", "hours", 24)


@R.query(_circular_sql("weekday_utc", 7))
def weekday_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rare a commit's weekday is for its author, on the circle of weekdays."""
    return _circular(spark, sf_dir, "weekday_utc", "weekdays", 7)


@R.query(f"""WITH {C}, {PROFILE}, a AS (SELECT repo, email, count(gap_seconds) AS n, avg(ln(gap_seconds + 1)) AS m, stddev_samp(ln(gap_seconds + 1)) AS sd,
  avg(ln(commit_delay_seconds + 1)) AS dm, stddev_samp(ln(commit_delay_seconds + 1)) AS dsd, avg(churn_ratio) AS cm, stddev_samp(churn_ratio) AS csd FROM prof GROUP BY ALL)
SELECT sha, round(abs((ln(gap_seconds + 1) - m) / nullif(sd, 0)), 5) AS gap_z, round(abs((ln(commit_delay_seconds + 1) - dm) / nullif(dsd, 0)), 5) AS delay_z, round(abs((churn_ratio - cm) / nullif(csd, 0)), 5) AS churn_z
FROM c JOIN a USING (repo, email)""")
def habit_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of gap, delay and churn of every commit from the author's mean, in standard deviations."""
    commits = _commits(spark, sf_dir, *NARROW)
    j = commits.join(P.author_profiles(commits).drop("hours", "weekdays"), ["repo", "email"])
    z = lambda x, name: F.round(S.z_score(x, F.col(f"{name}_mean"), F.col(f"{name}_sd")), 5).alias(f"{name}_z")
    return j.select("sha", z(F.log(F.col("gap_seconds") + 1), "gap"), z(F.log(F.col("commit_delay_seconds") + 1), "delay"), z(F.col("churn_ratio"), "churn"))


# erf(z) = 2 / sqrt(pi) exp(-z^2) sum of 2^k z^(2k+1) / (1 * 3 * ... * (2k+1)): all terms positive, so no digits are lost
_ERF = """CASE WHEN {z} = 0 THEN 0 WHEN {z} > 5.9 THEN 1 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda k: exp(-{z} * {z} + k * ln(2) + (2 * k + 1) * ln({z}) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END"""


def _normal_sql(x: str, n: str, m: str, sd: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {n} IS NULL OR {n} < 5 OR {sd} IS NULL OR {sd} < 1.5 THEN 0.5 ELSE {_ERF.format(z=f'(abs({x} - {m}) / {sd} / sqrt(2))')} END"


_HABITS = """a AS (SELECT repo, email, count(gap_seconds) AS gn, avg(ln(gap_seconds + 1)) AS gm, stddev_samp(ln(gap_seconds + 1)) AS gsd, count(commit_delay_seconds) AS dn, avg(ln(commit_delay_seconds + 1)) AS dm, stddev_samp(ln(commit_delay_seconds + 1)) AS dsd,
  count(churn_ratio) AS cn, avg(churn_ratio) AS cm, stddev_samp(churn_ratio) AS csd FROM prof GROUP BY ALL)"""


@R.query(f"""WITH {C}, {PROFILE}, {_HABITS}
SELECT sha, round({_normal_sql("ln(gap_seconds + 1)", "gn", "gm", "gsd")}, 6) AS gap, round({_normal_sql("ln(commit_delay_seconds + 1)", "dn", "dm", "dsd")}, 6) AS delay, round({_normal_sql("churn_ratio", "cn", "cm", "csd")}, 6) AS churn FROM c JOIN a USING (repo, email)""")
def habit_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as probabilities (error function)."""
    commits = _commits(spark, sf_dir, *NARROW)
    j = commits.join(P.author_profiles(commits).drop("hours", "weekdays"), ["repo", "email"])
    r = lambda x, name: F.round(S.normal_rarity(x, F.col(f"{name}_n"), F.col(f"{name}_mean"), F.col(f"{name}_sd")), 6).alias(name)
    return j.select("sha", r(F.log(F.col("gap_seconds") + 1), "gap"), r(F.log(F.col("commit_delay_seconds") + 1), "delay"), r(F.col("churn_ratio"), "churn"))


_TYPES = f"""WITH {C}, t AS (SELECT repo, email, sha, ft, count(*) AS n FROM (SELECT repo, email, sha, unnest(filetypes) AS ft FROM c) WHERE ft IS NOT NULL GROUP BY ALL)"""


@R.query(f"""{_TYPES}, n AS (SELECT repo, count(*) AS commits FROM c GROUP BY repo), s AS (SELECT repo, ft AS filetype, sum(n)::BIGINT AS n_files, count(*) AS n_commits FROM t GROUP BY ALL)
SELECT repo, filetype, n_files, n_commits, round(n_files * 100.0 / sum(n_files) OVER (PARTITION BY repo), 6) AS pct, round(n_commits / commits, 6) AS freq FROM s JOIN n USING (repo)""")
def type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File types of a repository: share of file changes, share of commits."""
    s = P.type_shares(P.type_statistics(_commits(spark, sf_dir, "repo", "filetypes"), ["repo"], pairs=False), ["repo"])
    return s.withColumns({"pct": F.round("pct", 6), "freq": F.round("freq", 6)})


@R.query(f"""{_TYPES}, n AS (SELECT repo, email, count(*) AS commits FROM c GROUP BY ALL), s AS (SELECT repo, email, ft AS filetype, sum(n)::BIGINT AS n_files, count(*) AS n_commits FROM t GROUP BY ALL)
SELECT repo, email, filetype, n_files, n_commits, round(n_files * 100.0 / sum(n_files) OVER (PARTITION BY repo, email), 6) AS pct, round(n_commits / commits, 6) AS freq FROM s JOIN n USING (repo, email)""")
def author_type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File types of an author: share of file changes, share of commits."""
    keys = ["repo", "email"]
    s = P.type_shares(P.type_statistics(_commits(spark, sf_dir, *keys, "filetypes"), keys, pairs=False), keys)
    return s.withColumns({"pct": F.round("pct", 6), "freq": F.round("freq", 6)})


@R.query(f"""{_TYPES}, n AS (SELECT repo, count(*) AS commits FROM c GROUP BY repo),
p AS (SELECT x.repo, x.ft AS a, y.ft AS b, log10(x.n / y.n) AS ratio FROM t x JOIN t y ON x.sha = y.sha AND x.ft < y.ft)
SELECT repo, a, b, count(*) AS n, round(count(*) / any_value(commits), 6) AS freq, round(avg(ratio), 6) + 0 AS mean, CASE WHEN count(*) >= 10 THEN round(stddev_samp(ratio), 6) END AS sd FROM p JOIN n USING (repo) GROUP BY repo, a, b""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of file types of a repository: commits with both, mean and deviation of the log ratio of their counts."""
    p = P.pair_shares(stage(P.type_statistics(_commits(spark, sf_dir, "repo", "filetypes"), ["repo"]), "type-statistics"), ["repo"])
    return p.withColumns({"freq": F.round("freq", 6), "mean": F.round("mean", 6) + 0, "sd": F.when(F.col("n") >= S.MIN_PAIR_SAMPLES, F.round("sd", 6))})


@R.query(f"""WITH {C}, {PROFILE}, n AS (SELECT repo, email, count(*) AS total FROM prof GROUP BY ALL),
d AS (SELECT repo, email, dir, count(*) AS n FROM (SELECT repo, email, unnest(list_distinct(top_dirs)) AS dir FROM prof) GROUP BY ALL),
x AS (SELECT sha, repo, email, unnest(list_distinct(top_dirs)) AS dir FROM c)
SELECT sha, round(1 - min(coalesce(d.n, 0)) / any_value(total), 6) AS rarity FROM x LEFT JOIN d USING (repo, email, dir) JOIN n USING (repo, email) GROUP BY sha HAVING any_value(total) >= 5""")
def dir_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rarely the author touches the rarest directory of a commit; authors with at least five profile commits."""
    commits = _commits(spark, sf_dir, *NARROW)
    keys = ["repo", "email"]
    total = P.author_profiles(commits).select(*keys, "profile_total").where(F.col("profile_total") >= S.MIN_SAMPLES)
    touched = commits.select("sha", *keys, F.explode(F.array_distinct("top_dirs")).alias("top_dir"))
    j = touched.join(P.directory_counts(commits), [*keys, "top_dir"], "left").join(total, keys)
    return j.groupBy("sha").agg(F.round(1 - F.min(F.coalesce("n", F.lit(0))) / F.first("profile_total"), 6).alias("rarity"))


@R.query(f"""WITH {C}, {PROFILE}, a AS (SELECT repo, email, count(*) AS total, count(*) FILTER (coalesce(gpg_signed, false)) AS signed, count(*) FILTER (coalesce(mismatch, false)) AS mm FROM prof GROUP BY ALL)
SELECT sha, CASE WHEN total >= 5 AND signed > total * 0.5 AND NOT coalesce(gpg_signed, false) THEN 0.85::DOUBLE ELSE 0::DOUBLE END AS signing,
CASE WHEN total >= 5 AND coalesce(mismatch, false) AND mm / total < 0.2 THEN round(0.35 * (1 - mm / total / 0.2), 6) ELSE 0 END AS identity FROM c JOIN a USING (repo, email)""")
def identity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned commits of authors who usually sign; commits by another committer where that is rare."""
    commits = _commits(spark, sf_dir, *NARROW)
    j = commits.join(P.author_profiles(commits).select("repo", "email", "profile_total", "signed_count", "mismatch_count"), ["repo", "email"])
    total = F.col("profile_total")
    return j.select(
        "sha",
        S.signing_score(F.col("gpg_signed"), F.col("signed_count"), total).alias("signing"),
        F.round(S.identity_score(F.col("author_committer_mismatch"), F.col("mismatch_count"), total), 6).alias("identity"),
    )


@R.query(f"""WITH {C} SELECT sha, place FROM (SELECT sha, row_number() OVER (PARTITION BY repo ORDER BY seq DESC, sha) AS place FROM c) WHERE place <= {S.WINDOW}""")
def latest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 latest commits of each repository."""
    return latest(_commits(spark, sf_dir, "repo", "seq"), S.WINDOW).withColumn("place", F.col("place").cast("long"))


@R.query(f"WITH {C} SELECT repo, email, count(*) AS n_commits, count(*) > {S.ESTABLISHED} AS established FROM c GROUP BY repo, email")
def established_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of each author, and whether they are enough for a profile."""
    n = F.count(F.lit(1))
    return _commits(spark, sf_dir, "repo", "email").groupBy("repo", "email").agg(n.alias("n_commits"), (n > S.ESTABLISHED).alias("established"))


@R.query(f"""WITH {C}, {PROFILE}, a AS (SELECT repo, email, count(*) AS total, count(gap_seconds) AS n_gaps, sum(gap_seconds)::DOUBLE AS gaps, count(*) FILTER (coalesce(gpg_signed, false)) AS signed_count, count(*) FILTER (coalesce(mismatch, false)) AS mismatch_count,
  list_sort(list(weekday_utc))::VARCHAR AS weekdays FROM prof GROUP BY ALL)
SELECT a.repo, a.email, a.total = h.total AS same_total, n_gaps = len(h.gaps) AS same_gaps, round(a.gaps - list_sum(h.gaps), 2) + 0 AS gap_difference, a.signed_count = h.signed_count AS same_signed, a.mismatch_count = h.mismatch_count AS same_mismatch
FROM a JOIN author_history h USING (repo, email)""")
def history_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt author profiles against the stored ones, as far as both have the author."""
    commits = _commits(spark, sf_dir, *NARROW)
    a = P.author_profiles(commits).select("repo", "email", "profile_total", "gap_n", F.col("signed_count").alias("signed"), F.col("mismatch_count").alias("mismatches"))
    gaps = P.without_last(commits).groupBy("repo", "email").agg(F.sum("gap_seconds").alias("gap_sum"))
    h = table(spark, sf_dir, "author_history").select("repo", "email", "gaps", "total", "signed_count", "mismatch_count")
    j = a.join(gaps, ["repo", "email"]).join(h, ["repo", "email"])
    stored = F.when(F.size("gaps") > 0, F.aggregate("gaps", F.lit(0.0), lambda x, y: x + y))
    return j.select(
        "repo",
        "email",
        (F.col("profile_total") == F.col("total")).alias("same_total"),
        (F.col("gap_n") == F.size("gaps")).alias("same_gaps"),
        (F.round(F.col("gap_sum") - stored, 2) + 0).alias("gap_difference"),
        (F.col("signed") == F.col("signed_count")).alias("same_signed"),
        (F.col("mismatches") == F.col("mismatch_count")).alias("same_mismatch"),
    )
