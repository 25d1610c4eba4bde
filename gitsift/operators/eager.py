"""Join results per key without joining rows: eager aggregation through the join.

Both inputs are reduced to one compact state per key before they meet, so a key
that owns a third of all rows sends one state per map task instead of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: Sequence[str], sums: Sequence[str], side: str) -> DataFrame:
    """Per key: row count ``n_<side>``, and of each summed column its sum and its non-null count.

    Map-side partial aggregation bounds what a key sends to one row per task.
    """
    aggs = [F.count(F.lit(1)).alias(f"n_{side}")]
    for c in sums:
        aggs += [F.sum(c).alias(f"{side}_sum_{c}"), F.count(c).alias(f"{side}_cnt_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Aggregates per key of ``left JOIN right USING (keys)``, the join never being built.

    Columns: the keys, ``n_left``, ``n_right`` (rows of each side), ``join_rows``
    (rows of the join), and for each summed column ``sum_<c>_left`` or
    ``sum_<c>_right``: its sum over the joined rows, i.e. the side's own sum times the
    other side's row count.

    how: ``inner`` or ``full``. With ``full``, unmatched keys stay: a missing
    side counts 0 rows, ``join_rows`` then is the row count of the present side,
    and sums of the missing side are null. Null keys never match; with ``full``
    the null groups of the two sides come out as separate rows. A sum over no non-null value is null,
    as in SQL. Other columns, equal names on both sides included, are never read.
    Empty inputs give an empty result (``full``: the other side's keys).
    """
    if how not in ("inner", "full"):
        raise ValueError("how is 'inner' or 'full'")
    l = key_states(left, keys, left_sums, "left")
    r = key_states(right, keys, right_sums, "right")
    j = l.join(r, list(keys), how)
    n_l, n_r = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    one = lambda n: F.greatest(n, F.lit(1))  # noqa: E731  an unmatched row of an outer join appears once
    out = [*keys, n_l.alias("n_left"), n_r.alias("n_right"), (one(n_l) * one(n_r)).alias("join_rows")]
    out += [(F.col(f"left_sum_{c}") * one(n_r)).alias(f"sum_{c}_left") for c in left_sums]
    out += [(F.col(f"right_sum_{c}") * one(n_l)).alias(f"sum_{c}_right") for c in right_sums]
    return j.select(*out)


def roll_up(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the counts and sums of :func:`eager_join_aggregate` up to coarser keys."""
    measures = [c for c in states.columns if c in ("n_left", "n_right", "join_rows") or c.startswith("sum_")]
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def heavy_keys(states: DataFrame, count: str, num: int, den: int) -> DataFrame:
    """Rows of ``states`` whose ``count`` is at least ``num / den`` of all (exact, in integers)."""
    total = states.agg(F.sum(count).alias("t"))
    return states.where((F.col(count) > 0) & (F.col(count) * den >= total.select(F.col("t") * num).scalar()))
