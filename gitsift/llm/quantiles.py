"""Mergeable percentiles with bounded relative error: counts in signed logarithmic buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gamma_of(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha is the relative error, between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket(x: Column, alpha: float) -> Column:
    """Struct (sign, index) of the bucket of ``x``: |x| in (gamma^(index-1), gamma^index]; zero has sign 0, index 0."""
    index = F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma_of(alpha)))).cast("int")
    return F.struct(
        F.signum(x).cast("int").alias("sign"),
        F.when(x != 0, index).otherwise(0).alias("index"),
    )


def bucket_value(sign: Column, index: Column, alpha: float) -> Column:
    """The value in the bucket that is within ``alpha`` of every value in it, relatively."""
    g = gamma_of(alpha)
    return sign * F.lit(2.0) * F.pow(F.lit(g), index.cast("double")) / F.lit(g + 1)


def sketch(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """Bucket counts: one row per key, ``metric``, ``sign`` and ``index`` with its count ``n``.

    Null, NaN and infinite values are not counted. The buckets of a metric are
    bounded (about 4,500 for 64-bit integers and alpha 0.01), and map-side
    combining sends at most these per key and task, however many rows a key has. An
    empty table, or a key without any value, has no rows. Extra columns are not read.
    """
    names = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(metrics)}, {names}) as (metric, x)")
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    return (
        long.where(finite)
        .select(*keys, "metric", bucket(F.col("x"), alpha).alias("b"))
        .groupBy(*keys, "metric", F.col("b.sign").alias("sign"), F.col("b.index").alias("index"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add matching bucket counts up to fewer keys; merging is exact, in any order and grouping."""
    return sketches.groupBy(*keys, "metric", "sign", "index").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], ps: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """One row per key, metric and p in ``ps``: ``n`` values, and ``value`` within relative error ``alpha``.

    The estimate is of the value of rank floor(p * (n - 1)), counted from 0 (the
    lower median for p = 0.5). ``alpha`` must be the one the sketch was made with.
    The window per key runs over its buckets, whose number is bounded.
    """
    g = [*keys, "metric"]
    value = bucket_value(F.col("sign"), F.col("index"), alpha)
    order = W.partitionBy(*g).orderBy(F.col("sign") * F.lit(1), F.col("sign") * F.col("index"))
    upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("n").over(W.partitionBy(*g))
    p = F.explode(F.array(*[F.lit(float(x)) for x in ps]))
    rank = F.floor(F.col("p") * (F.col("total") - 1))
    return (
        sketches.select(*g, value.alias("value"), "n", upto.alias("upto"), total.alias("total"))
        .select("*", p.alias("p"))
        .where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
        .select(*g, "p", F.col("total").alias("n"), "value")
    )
