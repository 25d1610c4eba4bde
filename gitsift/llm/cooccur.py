"""Items that appear together: pair counts per basket, lift and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitsift.session import stage


def cooccurrence(baskets: DataFrame, items: str, min_count: int = 1) -> DataFrame:
    """Pairs of different items with the number of baskets that hold both, lift and PMI.

    ``baskets`` has one row per basket and an array column ``items``. Items are
    deduplicated within a basket; null items are no items; a null or empty array
    still counts as a basket. Columns: ``item_a`` < ``item_b`` (by UTF-8 bytes),
    ``n_ab``, ``n_a``, ``n_b``, ``n`` (all baskets), ``lift`` = n_ab * n / (n_a * n_b),
    ``pmi`` = ln(lift). Pairs in fewer than ``min_count`` baskets are not returned. No
    baskets, or none with two items, give an empty result. Other columns are not read.

    Each basket emits its ordered pairs (a, b) with a < b, each item as (a, a) for
    the marginals, and (null, null) for the basket, so one aggregation with
    map-side combining counts everything: a frequent item sends one row per map
    task. The places of a basket are spread over rows before the partners are, so no row
    holds all pairs of a large basket. The counts are stored once, as totals, marginals and pairs are all
    read from them; the marginals are joined on the item and AQE picks the way by their measured size.
    """
    s = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    i, nothing = F.col("i"), F.lit(None).cast("string")
    places = baskets.select(s.alias("s")).select("s", F.explode(F.sequence(F.lit(-1), F.size("s") - 1)).alias("i"))  # -1: the basket itself
    partners = F.when(i < 0, F.array(nothing)).otherwise(F.slice("s", i + 1, F.size("s")))
    pairs = places.select(F.when(i >= 0, F.get("s", i)).alias("a"), F.explode(partners).alias("b"))
    counts = stage(pairs.groupBy("a", "b").count(), "pair-counts")
    n = counts.where(F.col("a").isNull()).select("count").scalar()
    own = counts.where(F.col("a") == F.col("b"))
    n_ab, n_a, n_b, total = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    lift = n_ab * total / (n_a * n_b)
    return (
        counts.where((F.col("a") < F.col("b")) & (F.col("count") >= min_count))
        .select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("count").alias("n_ab"), n.alias("n"))
        .join(own.select(F.col("a").alias("item_a"), F.col("count").alias("n_a")), "item_a")
        .join(own.select(F.col("b").alias("item_b"), F.col("count").alias("n_b")), "item_b")
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log(lift).alias("pmi"))
    )
