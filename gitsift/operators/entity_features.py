"""Per-entity features from events, kept as time-bucketed partial aggregates.

The store is a Parquet table partitioned by time bucket with a few rows, added up when read, per
(bucket, entity, type). Features are merged from whole buckets plus the events of
the partly covered buckets at the two ends; when late events arrive, only the
buckets they fall in are computed anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET_FORMAT = "yyyy-MM"
NO_TIME = "none"


def bucket_of(ts: Column) -> Column:
    """Name of the calendar month of ``ts``; ``none`` for a null time."""
    return F.coalesce(F.date_format(ts, BUCKET_FORMAT), F.lit(NO_TIME))


def typed_events(events: DataFrame, entity: Sequence[str], types: str, ts: str, order: str, values: Sequence[str]) -> DataFrame:
    """One row per event and distinct type in the array ``types``, and one of null type per event; ``_bucket`` and ``_slot`` are kept.

    The row of null type stands for the event itself, so entities keep their
    event count though an event may have no type at all (null or empty array).
    Null array elements are no type.
    """
    kinds = F.filter(F.array_distinct(F.coalesce(F.col(types), F.array().cast("array<string>"))), lambda t: t.isNotNull())
    return events.select(
        "_bucket",
        "_slot",
        *entity,
        F.col(ts).alias("_ts"),
        F.col(order).alias("_order"),
        *values,
        F.explode(F.concat(kinds, F.array(F.lit(None).cast("string")))).alias("_type"),
    )


def partials(typed: DataFrame, entity: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One state per (``_bucket``, ``_slot``, entity, type): counts, first and last time, last order, sums."""
    return (
        typed.groupBy("_bucket", "_slot", *entity, "_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_ts").alias("first_ts"),
            F.max("_ts").alias("last_ts"),
            F.max("_order").alias("last_order"),
            *[F.sum(v).alias(f"sum_{v}") for v in values],
            *[F.count(v).alias(f"cnt_{v}") for v in values],
        )
    )


def merge(states: DataFrame, entity: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Combine states of several buckets into one per (entity, type)."""
    return states.groupBy(*entity, "_type").agg(
        F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("last_order").alias("last_order"),
        *[F.sum(f"sum_{v}").alias(f"sum_{v}") for v in values],
        *[F.sum(f"cnt_{v}").alias(f"cnt_{v}") for v in values],
    )


class BucketStore:
    """The partial aggregates of one event stream under ``path``.

    ``entity``: key columns; ``types``: an array column; ``ts``: event time;
    ``order``: a column whose largest value marks an entity's last event;
    ``values``: numeric columns that are summed (nulls are skipped and counted apart).
    ``unique``: column naming an event, if one may be delivered many times (null: not an event).

    A bucket is cut into slots of about ``rows_a_slot`` events, by its count, each made and written by one task. An entity's events of a
    bucket go to a third of its slots, so an entity that owns a third of all makes no slot more than twice as large; its states of
    these slots are added up when they are read.
    """

    def __init__(self, path: str, entity: Sequence[str], types: str, ts: str, order: str, values: Sequence[str] = (), unique: str | None = None, rows_a_slot: int = 2_000_000):
        self.path, self.entity, self.types, self.ts, self.order = path, list(entity), types, ts, order
        self.values, self.unique, self.rows_a_slot = list(values), unique, rows_a_slot
        self.schema: StructType | None = None  # of what was written, as a store without events has no file to tell it

    def _states(self, events: DataFrame) -> DataFrame:
        cols = list(dict.fromkeys([*self.entity, self.types, self.ts, self.order, *self.values, *([self.unique] if self.unique else [])]))
        all_events = events.select(self.ts)
        events = events.select(*cols)
        if self.unique:
            events = events.where(F.col(self.unique).isNotNull()).dropDuplicates([self.unique])
        name = bucket_of(F.col(self.ts))
        sizes = {b: -(-n // self.rows_a_slot) for b, n in all_events.groupBy(name).count().collect()}  # one number a bucket
        slots = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("_bucket")] if sizes else F.lit(1)
        spread = F.ceil(slots / 3)
        part = F.pmod(F.xxhash64(self.unique) if self.unique else F.xxhash64(self.ts, self.order), spread)
        slot = F.pmod(F.pmod(F.xxhash64(*self.entity), slots) + part, slots).cast("int")
        # one shuffle by slot serves the aggregate and the files
        placed = events.withColumn("_bucket", name).withColumn("_slot", slot).repartition("_bucket", "_slot")
        return partials(typed_events(placed, self.entity, self.types, self.ts, self.order, self.values), self.entity, self.values)

    def _write(self, states: DataFrame) -> None:
        self.schema = states.drop("_slot", "_bucket").withColumn("_bucket", F.lit("")).schema
        states.drop("_slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def build(self, events: DataFrame) -> BucketStore:
        self._write(self._states(events))
        return self

    def update(self, all_events: DataFrame, new_events: DataFrame) -> list[str]:
        """Recompute the buckets that ``new_events`` fall in from ``all_events``; returns their names.

        ``all_events`` includes the new ones. The list of bucket names is bounded
        by the months that the data spans, so it may pass through the driver.
        """
        changed = sorted(r[0] for r in new_events.select(bucket_of(F.col(self.ts))).distinct().collect())
        dated = [b for b in changed if b != NO_TIME]
        span = F.col(self.ts).isNull() if NO_TIME in changed else F.lit(False)
        if dated:  # a plain range on the time column reaches the scan; the bucket test then picks the months
            low, high = f"{dated[0]}-01", F.add_months(F.lit(f"{dated[-1]}-01").cast("date"), 1).cast("timestamp")
            span = span | ((F.col(self.ts) >= F.lit(low).cast("timestamp")) & (F.col(self.ts) < high))
        if changed:
            self._write(self._states(all_events.where(span & bucket_of(F.col(self.ts)).isin(changed))))
        return changed

    def states(self, spark: SparkSession) -> DataFrame:
        return (spark.read.schema(self.schema) if self.schema else spark.read).parquet(self.path)

    def by(self, entity: Sequence[str]) -> BucketStore:
        """The same store, its features taken by fewer key columns."""
        out = BucketStore(self.path, entity, self.types, self.ts, self.order, self.values, self.unique, self.rows_a_slot)
        out.schema = self.schema
        return out

    def features(self, spark: SparkSession, events: DataFrame | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """One row per (entity, type) over ``start <= ts < end``; type null is the entity as a whole.

        Without bounds all buckets are merged (events without a time included).
        With bounds, months wholly inside come from the store, and the events of the months that
        a bound cuts are read from ``events``.
        """
        states = self.states(spark)
        if start is None and end is None:
            return merge(states, self.entity, self.values)
        cut = []
        whole = F.col("_bucket") != NO_TIME
        inside = F.col(self.ts).isNotNull()
        if start is not None:
            first = start.strftime("%Y-%m")
            inside &= F.col(self.ts) >= F.lit(start)
            if start != start.replace(day=1, hour=0, minute=0, second=0, microsecond=0):
                cut.append(first)
            whole &= F.col("_bucket") >= first
        if end is not None:
            last = end.strftime("%Y-%m")
            inside &= F.col(self.ts) < F.lit(end)
            if end != end.replace(day=1, hour=0, minute=0, second=0, microsecond=0):
                cut.append(last)
                whole &= F.col("_bucket") <= last
            else:
                whole &= F.col("_bucket") < last
        states = states.where(whole & ~F.col("_bucket").isin(cut) if cut else whole)
        if cut:
            if events is None:
                raise ValueError("a bound inside a month needs the events of that month")
            states = states.unionByName(self._states(events.where(inside & bucket_of(F.col(self.ts)).isin(cut))).drop("_slot"))
        return merge(states, self.entity, self.values)


def feature_rows(features: DataFrame, entity: Sequence[str], values: Sequence[str], as_of: datetime | None = None) -> DataFrame:
    """One row per entity: totals of the entity and a map from type to its count, last time and sums.

    The maps hold one entry per type of the entity, so their size is bounded by
    the number of types, not by the number of events. ``recency_seconds`` (only
    with ``as_of``) is null if no event of the entity has a time.
    """
    sums = [f"sum_{v}" for v in values]
    total = lambda c: F.max(F.when(F.col("_type").isNull(), F.col(c)))
    entry = F.struct(F.col("_type"), F.struct("n", "last_ts", *sums))
    out = features.groupBy(*entity).agg(
        total("n").alias("n_events"),
        total("first_ts").alias("first_ts"),
        total("last_ts").alias("last_ts"),
        *[total(s).alias(s) for s in sums],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_type").isNotNull(), entry)))).alias("by_type"),
    )
    if as_of is not None:
        out = out.withColumn("recency_seconds", F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("last_ts"))
    return out
