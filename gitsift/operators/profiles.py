"""Distributions of a repository and of its authors: tail fits, type statistics, habit profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gitsift.functions.scoring import EPS, num

METRICS = ["total_loc", "loc_added", "loc_removed", "files_changed", "files_added", "files_removed", "commit_msg_words"]


def metric_values(commits: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Distinct values per key and metric with their number ``n``; null values are left out."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = commits.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(metrics)}, {pairs}) as (metric, value)")
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def weighted_ecdf(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``ecdf``, the share of the samples of a key that are at most ``value`` (ties included), and ``low``, the key's least value.

    ``values`` has one row per key and distinct value, with its number ``n``. The running sum is taken in two levels:
    inside buckets of near values, and over the bucket totals of the key (a few hundred), so a key with
    very many distinct values is no single task.
    """
    v = F.col("value")
    bucket = F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 16)
    # the keys as one value, equal where both have nulls: windows and join then share one shuffle
    rows = values.select(F.struct(*keys).alias("_key"), bucket.alias("_bucket"), "value", "n")
    totals = rows.groupBy("_key", "_bucket").agg(F.sum("n").alias("_in"), F.min("value").alias("_least"))
    order = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_key", "_bucket", F.coalesce(F.sum("_in").over(order), F.lit(0)).alias("_below"), F.sum("_in").over(W.partitionBy("_key")).alias("_total"), F.min("_least").over(W.partitionBy("_key")).alias("low"))
    inside = F.sum("n").over(W.partitionBy("_key", "_bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = rows.withColumn("_inside", inside).join(totals, ["_key", "_bucket"])
    return joined.select(*[F.col(f"_key.{k}").alias(k) for k in keys], "value", "n", "low", ((F.col("_below") + F.col("_inside")) / F.col("_total")).alias("ecdf"))


def tail_fits(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pareto tail per key: ``alpha``, ``beta`` of P(X > x) = (alpha / x)^beta, by least squares in logarithms.

    Regression of ln(1 + eps - ecdf) on ln(x + eps), each sample a point. A constant sample gets
    one more point, one above it. beta 0 has alpha 0.
    """
    single = values.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high")).where("_low = _high")
    extra = single.select(*keys, (F.col("_high") + 1).alias("value"), F.lit(1).cast("long").alias("n"))
    e = weighted_ecdf(values.select(*keys, "value", "n").unionByName(extra), keys)
    # ln(x + eps) is taken from the least value on, which keeps its digits where values lie close together
    low = F.col("low") + num(EPS)
    x, y, n = F.log1p((F.col("value") - F.col("low")) / low), F.log(num(1 + EPS) - F.col("ecdf")), F.col("n").cast("double")
    s = e.select(*keys, "low", n.alias("n"), x.alias("x"), y.alias("y")).groupBy(*keys).agg(
        F.log(F.first("low") + num(EPS)).alias("x0"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("x")).alias("sx"),
        F.sum(F.col("n") * F.col("y")).alias("sy"),
        F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("n") * F.col("x") * F.col("y")).alias("sxy"),
    )
    var = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(var > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(var > 0, var)).otherwise(num(0))
    beta = F.col("beta")
    intercept = (F.col("sy") + beta * F.col("sx")) / F.col("n") + beta * F.col("x0")
    alpha = F.when(beta != 0, F.exp(intercept / F.when(beta != 0, beta))).otherwise(num(0))
    return s.withColumn("beta", -slope).select(*keys, alpha.alias("alpha"), "beta")


def wide_fits(fits: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """One row per key: ``<metric>_alpha_<suffix>`` and ``<metric>_beta_<suffix>`` of each metric."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}_{suffix}")
    return fits.groupBy(*keys).agg(*[pick(m, c) for m in METRICS for c in ("alpha", "beta")])


def without_last(commits: DataFrame, keys: Sequence[str] = ("repo", "email")) -> DataFrame:
    """All commits of an author but the last in walk order, unless it is the only one.

    The last one is found by an aggregate with map-side combining, one row per author. It is taken out by its place in the
    walk as well as its author, so the rows are spread by commit and an author with very many stays spread.
    """
    last = commits.groupBy(*keys).agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, "seq")
    return commits.join(last, [*keys, "seq"], "left_anti")


def of_authors(commits: DataFrame, authors: DataFrame, keys: Sequence[str] = ("repo", "email"), parts: int = 32) -> DataFrame:
    """Commits whose ``keys`` are among ``authors`` (one row per author).

    Where the authors are too many to be broadcast by their measured size, both sides are shuffled by author and one of ``parts`` hash
    parts of the commits, so a frequent author's commits are spread; an aggregate by author on top combines before its own shuffle.
    """
    part = F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("int")
    each = authors.select(*keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return commits.withColumn("_part", part).join(each, [*keys, "_part"], "left_semi").drop("_part")


def author_profiles(commits: DataFrame, keys: Sequence[str] = ("repo", "email")) -> DataFrame:
    """Habits of each author, without the last commit: sufficient statistics of gaps, delays and churn,
    hour and weekday histograms, signing and identity counts."""
    log1 = lambda c: F.log(F.col(c) + num(1))
    stats = []
    for name, x in (("gap", log1("gap_seconds")), ("delay", log1("commit_delay_seconds")), ("churn", F.col("churn_ratio"))):
        stats += [F.count(x).alias(f"{name}_n"), F.avg(x).alias(f"{name}_mean"), F.stddev_samp(x).alias(f"{name}_sd")]
    return without_last(commits, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("profile_total"),
        *stats,
        F.array(*[F.count_if(F.col("hour_utc") == h) for h in range(24)]).alias("hours"),
        F.array(*[F.count_if(F.col("weekday_utc") == d) for d in range(7)]).alias("weekdays"),
        F.count_if(F.coalesce("gpg_signed", F.lit(False))).alias("signed_count"),
        F.count_if(F.coalesce("author_committer_mismatch", F.lit(False))).alias("mismatch_count"),
    )


def directory_counts(commits: DataFrame, keys: Sequence[str] = ("repo", "email")) -> DataFrame:
    """Profile commits of each author that touch a directory: keys, ``top_dir``, ``n``."""
    one = without_last(commits, keys).select(*keys, F.explode(F.array_distinct("top_dirs")).alias("top_dir"))
    return one.groupBy(*keys, "top_dir").agg(F.count(F.lit(1)).alias("n"))


def type_counts(filetypes: str = "filetypes"):
    """Column: array of (type, count, place of first appearance), sorted by type, of a bag of types; null types dropped."""
    bag = F.filter(F.coalesce(F.col(filetypes), F.array().cast("array<string>")), lambda t: t.isNotNull())
    kinds = F.array_sort(F.array_distinct(bag))
    return F.transform(kinds, lambda t: F.struct(t.alias("t"), F.size(F.filter(bag, lambda x: x == t)).alias("c"), F.array_position(bag, t).alias("place")))


def type_pairs(counts: str = "types"):
    """Column: array of (a, b, ratio) over pairs a < b of :func:`type_counts`, ratio the log10 of their counts' quotient."""
    c = F.col(counts)
    pair = lambda x, y: F.struct(x["t"].alias("a"), y["t"].alias("b"), F.log10(x["c"] / y["c"]).alias("ratio"))
    return F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.greatest(F.size(c), F.lit(1))), lambda y: pair(x, y))))


def type_statistics(commits: DataFrame, keys: Sequence[str], pairs: bool = True) -> DataFrame:
    """Per key, counts of commits, of their types and (with ``pairs``) of their pairs of types, from one aggregate with map-side combining.

    Columns: keys, ``a``, ``b`` (both null: the key as a whole; b null: a type), ``n`` commits, ``n_files`` file changes of a type,
    ``mean`` and ``sd`` (sample deviation) of the log ratio of a pair's counts.
    """
    kind = "struct<a:string,b:string,c:int,ratio:double>"
    null = lambda t: F.lit(None).cast(t)
    whole = F.array(F.struct(null("string").alias("a"), null("string").alias("b"), null("int").alias("c"), null("double").alias("ratio")))
    one = F.transform("types", lambda x: F.struct(x["t"].alias("a"), null("string").alias("b"), x["c"].alias("c"), null("double").alias("ratio")))
    two = [F.transform(type_pairs(), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), null("int").alias("c"), p["ratio"].alias("ratio")))] if pairs else []
    rows = commits.select(*keys, type_counts().alias("types"))
    x = rows.select(*keys, F.explode(F.concat(whole.cast(f"array<{kind}>"), *[x.cast(f"array<{kind}>") for x in (one, *two)])).alias("x"))
    return x.groupBy(*keys, F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x.c").alias("n_files"), F.avg("x.ratio").alias("mean"), F.stddev_samp("x.ratio").alias("sd")
    )


def _with_total(stats: DataFrame, which: str, keys: Sequence[str]) -> DataFrame:
    totals = stats.where("a is null").select(*keys, F.col("n").alias("_commits"))
    return stats.where(which).join(totals, list(keys))


def type_shares(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From :func:`type_statistics`, per key and type: ``pct`` of all file changes, ``n_commits`` that touch it, ``freq`` = share of all commits.

    The window runs over the types of a key.
    """
    all_files = F.sum("n_files").over(W.partitionBy(*keys))
    return _with_total(stats, "a is not null and b is null", keys).select(
        *keys, F.col("a").alias("filetype"), "n_files", F.col("n").alias("n_commits"), (F.col("n_files") * 100.0 / all_files).alias("pct"), (F.col("n") / F.col("_commits")).alias("freq")
    )


def pair_shares(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From :func:`type_statistics`, per key and pair of types: ``n`` commits with both, ``freq``, and mean and sample deviation of the log ratio of their counts."""
    return _with_total(stats, "b is not null", keys).select(*keys, "a", "b", "n", (F.col("n") / F.col("_commits")).alias("freq"), "mean", "sd")
