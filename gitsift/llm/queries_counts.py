"""Queries of the counting problems: percentiles, co-occurrence, term frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitsift.llm.cooccur import cooccurrence
from gitsift.llm.ngrams import mark_terms, ngram_counts
from gitsift.llm.quantiles import merge_sketches, percentiles, sketch
from gitsift.llm.queries import R
from gitsift.session import distinct_commits, stage, table

ALPHA = 0.01
METRICS = ("total_loc", "loc_added", "files_changed", "commit_msg_words")
PS = (0.25, 0.5, 0.75, 0.9, 0.99)


@R.query(f"""
WITH c AS (SELECT sha, any_value(repo) AS repo, any_value(email) AS email, any_value(total_loc) AS total_loc, any_value(loc_added) AS loc_added,
                  any_value(files_changed) AS files_changed, any_value(commit_msg_words) AS commit_msg_words FROM commits WHERE sha IS NOT NULL GROUP BY sha),
u AS (UNPIVOT (SELECT repo, email, {", ".join(f"{m}::DOUBLE AS {m}" for m in METRICS)} FROM c) ON {", ".join(METRICS)} INTO NAME metric VALUE x),
s AS (SELECT 'repo' AS scope, repo AS key, metric, x FROM u UNION ALL SELECT 'email', email, metric, x FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY scope, key, metric ORDER BY x) - 1 AS rank, count(*) OVER (PARTITION BY scope, key, metric) AS n FROM s),
p AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in PS)}]) AS p),
v AS (SELECT scope, key, metric, p, n, x FROM o JOIN p ON rank = floor(p * (n - 1)))
SELECT scope, key, metric, p, n, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * 2 * power({(1 + ALPHA) / (1 - ALPHA)!r}::DOUBLE,
       ceil(ln(abs(x)) / ln({(1 + ALPHA) / (1 - ALPHA)!r}::DOUBLE))) / {(1 + ALPHA) / (1 - ALPHA) + 1!r}::DOUBLE END, 4) AS value FROM v
""")
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the size metrics for each repository and each author, within 1 % of the exact value.

    Sketches are made per (repo, email) once and merged up to either key.
    """
    commits = distinct_commits(table(spark, sf_dir, "commits"), "repo", "email", *METRICS)
    fine = sketch(commits, ["repo", "email"], METRICS, ALPHA)
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("scope"), F.col(k).alias("key")) for k in ("repo", "email")]))
    both = fine.select(key.alias("k"), "metric", "sign", "index", "n").select("k.scope", "k.key", "metric", "sign", "index", "n")
    keys = ["scope", "key"]
    return percentiles(merge_sketches(both, keys), keys, PS, ALPHA).withColumn("value", F.round("value", 4))


@R.query(f"""
WITH c AS (SELECT sha, any_value(repo) AS repo, coalesce(strftime(any_value(authored_ts), '%Y-%m'), 'none') AS month, any_value(total_loc) AS total_loc, any_value(loc_added) AS loc_added,
                  any_value(files_changed) AS files_changed, any_value(commit_msg_words) AS commit_msg_words FROM commits WHERE sha IS NOT NULL GROUP BY sha),
u AS (UNPIVOT (SELECT repo, month, {", ".join(f"{m}::DOUBLE AS {m}" for m in METRICS)} FROM c) ON {", ".join(METRICS)} INTO NAME metric VALUE x),
o AS (SELECT *, row_number() OVER (PARTITION BY repo, month, metric ORDER BY x) - 1 AS rank, count(*) OVER (PARTITION BY repo, month, metric) AS n FROM u),
v AS (SELECT repo, month, metric, p, n, x FROM o JOIN (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in PS)}]) AS p) ON rank = floor(p * (n - 1)))
SELECT repo, month, metric, p, n, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * 2 * power({(1 + ALPHA) / (1 - ALPHA)!r}::DOUBLE,
       ceil(ln(abs(x)) / ln({(1 + ALPHA) / (1 - ALPHA)!r}::DOUBLE))) / {(1 + ALPHA) / (1 - ALPHA) + 1!r}::DOUBLE END, 4) AS value FROM v
""")
def p4_monthly_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles for each repository and month, combined from stored sketches of single days ('none': commits without a time)."""
    commits = distinct_commits(table(spark, sf_dir, "commits"), "repo", "authored_ts", *METRICS)
    daily = stage(sketch(commits.withColumn("day", F.to_date("authored_ts")), ["repo", "day"], METRICS, ALPHA), "daily-sketches")
    months = daily.withColumn("month", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")))
    keys = ["repo", "month"]
    return percentiles(merge_sketches(months, keys), keys, PS, ALPHA).withColumn("value", F.round("value", 4))


@R.query("""
WITH c AS (SELECT sha, any_value(list_filter(list_distinct(coalesce(filetypes, [])), lambda x: x IS NOT NULL)) AS t FROM commits WHERE sha IS NOT NULL GROUP BY sha),
u AS (SELECT sha, unnest(t) AS t FROM c), m AS (SELECT t, count(*) AS n_x FROM u GROUP BY t),
p AS (SELECT a.t AS ta, b.t AS tb, count(*) AS n_ab FROM u a JOIN u b ON a.sha = b.sha AND a.t < b.t GROUP BY ALL)
SELECT ta AS filetype_a, tb AS filetype_b FROM p JOIN m ma ON ma.t = ta JOIN m mb ON mb.t = tb
WHERE n_ab >= 5 AND n_ab * 1000 >= (SELECT count(*) FROM c) AND n_ab * (SELECT count(*) FROM c) >= 3 * ma.n_x * mb.n_x
""")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of file types that stand together at least three times as often as chance would have it."""
    pairs = _filetype_pairs(spark, sf_dir)
    n_ab, n = F.col("n_ab"), F.col("n")
    strong = (n_ab >= 5) & (n_ab * 1000 >= n) & (n_ab * n >= 3 * F.col("n_a") * F.col("n_b"))
    return pairs.where(strong).select(F.col("item_a").alias("filetype_a"), F.col("item_b").alias("filetype_b"))


@R.query("""
WITH c AS (SELECT sha, any_value(list_filter(list_distinct(coalesce(filetypes, [])), lambda x: x IS NOT NULL)) AS t FROM commits WHERE sha IS NOT NULL GROUP BY sha),
u AS (SELECT sha, unnest(t) AS t FROM c), m AS (SELECT t, count(*) AS n_x FROM u GROUP BY t),
p AS (SELECT a.t AS ta, b.t AS tb, count(*) AS n_ab FROM u a JOIN u b ON a.sha = b.sha AND a.t < b.t GROUP BY ALL)
SELECT ta AS item_a, tb AS item_b, n_ab, ma.n_x AS n_a, mb.n_x AS n_b, round(n_ab::DOUBLE * (SELECT count(*) FROM c) / (ma.n_x::DOUBLE * mb.n_x), 4) AS lift
FROM p JOIN m ma ON ma.t = ta JOIN m mb ON mb.t = tb WHERE n_ab >= 5
""")
def p5_filetype_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of file types in at least five commits, with counts and lift."""
    return _filetype_pairs(spark, sf_dir).where("n_ab >= 5").select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 4).alias("lift"))


@R.query("""
WITH c AS (SELECT sha, any_value(list_filter(list_distinct(coalesce(filetypes, [])), lambda x: x IS NOT NULL)) AS t FROM commits WHERE sha IS NOT NULL GROUP BY sha),
u AS (SELECT sha, unnest(t) AS t FROM c), m AS (SELECT t, count(*) AS n_x FROM u GROUP BY t),
p AS (SELECT a.t AS ta, b.t AS tb, count(*) AS n_ab FROM u a JOIN u b ON a.sha = b.sha AND a.t < b.t GROUP BY ALL)
SELECT ta AS item_a, tb AS item_b, n_ab, ma.n_x AS n_a, mb.n_x AS n_b, n_ab::DOUBLE * (SELECT count(*) FROM c) / (ma.n_x::DOUBLE * mb.n_x) AS lift
FROM p JOIN m ma ON ma.t = ta JOIN m mb ON mb.t = tb
""")
def p5_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of different file types that stands in a commit at all, with counts and unrounded lift."""
    return _filetype_pairs(spark, sf_dir).select("item_a", "item_b", "n_ab", "n_a", "n_b", "lift")


def _filetype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = distinct_commits(table(spark, sf_dir, "commits"), "filetypes")
    return cooccurrence(baskets, "filetypes")


def _term_counts(spark: SparkSession, sf_dir: str, shortest: int, longest: int | None, min_tf: int = 1) -> DataFrame:
    """Counts of n-grams of the terms of distinct commits, from whole suffixes."""
    commits = distinct_commits(table(spark, sf_dir, "commits"), "filetypes", "top_dirs")
    field = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("terms"))
    long = commits.select(F.explode(F.array(field("filetypes"), field("top_dirs"))).alias("f")).select("f.field", "f.terms")
    return ngram_counts(long, "terms", None, ["field"], shortest, longest, min_tf)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "commits").agg(F.count_distinct("sha").alias("n"))
    return mark_terms(_term_counts(spark, sf_dir, 1, 1), n, 2, 20, 100)


_TERMS = """
WITH c AS (SELECT sha, any_value(filetypes) AS filetypes, any_value(top_dirs) AS top_dirs FROM commits WHERE sha IS NOT NULL GROUP BY sha),
u AS (SELECT 'filetypes' AS field, sha, unnest(filetypes) AS term FROM c UNION ALL SELECT 'top_dirs', sha, unnest(top_dirs) FROM c),
t AS (SELECT field, term, count(*) AS tf, count(DISTINCT sha) AS df FROM u WHERE term IS NOT NULL GROUP BY field, term),
m AS (SELECT *, CASE WHEN df * 100 >= 20 * (SELECT count(*) FROM c) THEN 'common' WHEN df <= 2 THEN 'rare' END AS mark FROM t)
"""


@R.query(_TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in at most two commits, or in at least a fifth of all."""
    return _marked(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", F.col("ngram")[0].alias("term"), "mark")


@R.query(_TERMS + "SELECT field, term, tf, df, mark FROM m")
def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term with its occurrences, its commits and its mark."""
    return _marked(spark, sf_dir).select("field", F.col("ngram")[0].alias("term"), "tf", "df", "mark")


@R.query("""
WITH c AS (SELECT sha, any_value(list_filter(filetypes, lambda x: x IS NOT NULL)) AS filetypes, any_value(list_filter(top_dirs, lambda x: x IS NOT NULL)) AS top_dirs FROM commits WHERE sha IS NOT NULL GROUP BY sha),
l AS (SELECT 'filetypes' AS field, sha, filetypes AS t FROM c UNION ALL SELECT 'top_dirs', sha, top_dirs FROM c),
b AS (SELECT field, sha, unnest(list_zip(t[:-2], t[2:])) AS p FROM l WHERE len(t) >= 2)
SELECT field, p[1] AS first_term, p[2] AS second_term, count(*) AS tf, count(DISTINCT sha) AS df FROM b GROUP BY ALL
""")
def p6_neighbour_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of terms that follow each other in a commit, with occurrences and commits."""
    counts = _term_counts(spark, sf_dir, 2, 2)
    return counts.select("field", F.col("ngram")[0].alias("first_term"), F.col("ngram")[1].alias("second_term"), "tf", "df")


@R.query("""
WITH c AS (SELECT sha, any_value(list_filter(filetypes, lambda x: x IS NOT NULL)) AS filetypes, any_value(list_filter(top_dirs, lambda x: x IS NOT NULL)) AS top_dirs FROM commits WHERE sha IS NOT NULL GROUP BY sha),
l AS (SELECT 'filetypes' AS field, sha, filetypes AS t FROM c UNION ALL SELECT 'top_dirs', sha, top_dirs FROM c),
s AS (SELECT field, sha, t[i:] AS t FROM (SELECT field, sha, t, unnest(range(1, len(t) - 1)) AS i FROM l WHERE len(t) >= 3)),
g AS (SELECT field, sha, t[:n] AS g FROM (SELECT field, sha, t, unnest(range(3, len(t) + 1)) AS n FROM s))
SELECT field, len(g)::INT AS n_terms, array_to_string(g, ' ') AS terms, count(*) AS tf, count(DISTINCT sha) AS df FROM g GROUP BY field, g HAVING count(*) >= 2
""")
def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of three or more terms, of any length, that occurs at least twice, with occurrences and commits."""
    counts = _term_counts(spark, sf_dir, 3, None, 2)
    return counts.select("field", F.size("ngram").alias("n_terms"), F.array_join("ngram", " ").alias("terms"), "tf", "df")
