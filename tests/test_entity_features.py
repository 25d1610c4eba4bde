import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gitsift.operators.entity_features import BucketStore, feature_rows

SCHEMA = "id string, who string, dirs array<string>, at timestamp, ord long, v double, n int"


def events(n, seed=3):
    r = random.Random(seed)
    start = datetime(2023, 1, 10)
    out = []
    for i in range(n):
        dirs = r.choice([None, [], ["src"], ["src", "src", "docs"], ["a b", None], ["docs", "x"]])
        at = None if r.random() < 0.05 else start + timedelta(hours=r.randrange(24 * 200))
        out.append((f"e{i}", r.choice(["hot", "hot", "hot", "p", "q", None]), dirs, at, i, r.choice([None, 1.5, 2.0]), 7))
    return out


def store(spark, path, rows_a_slot=7):
    return BucketStore(str(path), ("who",), "dirs", "at", "ord", ("v",), unique="id", rows_a_slot=rows_a_slot)


def brute(rows, start=None, end=None):
    n, last = Counter(), {}
    for _, who, dirs, at, *_ in {r[0]: r for r in rows}.values():
        if (start or end) and (at is None or start and at < start or end and at >= end):
            continue
        for t in {None, *(d for d in dirs or [] if d is not None)}:
            n[who, t] += 1
            if at and (last.get((who, t)) is None or at > last[who, t]):
                last[who, t] = at
    return {k: (c, last.get(k)) for k, c in n.items()}


def as_dict(frame):
    return {(r.who, r._type): (r.n, r.last_ts) for r in frame.collect()}


def test_slots_do_not_change_features(spark, tmp_path):
    rows = events(300)
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    for k, n in enumerate((1, 30, 10**6)):
        assert as_dict(store(spark, tmp_path / str(k), n).build(df).features(spark)) == brute(rows)


def test_all_time(spark, tmp_path):
    rows = events(300)
    s = store(spark, tmp_path / "s").build(spark.createDataFrame(rows + rows[:50], SCHEMA))
    assert as_dict(s.features(spark)) == brute(rows)


@pytest.mark.parametrize("start,end", [(datetime(2023, 2, 1), datetime(2023, 5, 1)), (datetime(2023, 2, 11, 5), datetime(2023, 4, 20)), (None, datetime(2023, 3, 3)), (datetime(2023, 3, 3), None), (datetime(2023, 3, 3), datetime(2023, 3, 9))])
def test_ranges_merge_buckets_and_boundary_events(spark, tmp_path, start, end):
    rows = events(300)
    df = spark.createDataFrame(rows, SCHEMA)
    s = store(spark, tmp_path / "s").build(df)
    assert as_dict(s.features(spark, df, start, end)) == brute(rows, start, end)


def test_update_touches_changed_buckets_only(spark, tmp_path):
    rows = events(300)
    old, new = rows[:290], rows[290:] + rows[:3]
    s = store(spark, tmp_path / "s").build(spark.createDataFrame(old, SCHEMA))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    changed = s.update(spark.createDataFrame(rows + rows[:3], SCHEMA), spark.createDataFrame(new, SCHEMA))
    assert as_dict(s.features(spark)) == brute(rows)
    kept = [p for p in before if not any(f"_bucket={c}/" in str(p) for c in changed)]
    assert kept and all(p.exists() and p.stat().st_mtime_ns == before[p] for p in kept)


def test_feature_rows(spark, tmp_path):
    rows = events(100)
    s = store(spark, tmp_path / "s").build(spark.createDataFrame(rows, SCHEMA))
    got = {r.who: r for r in feature_rows(s.features(spark), ("who",), ("v",), datetime(2024, 1, 1)).collect()}
    want = brute(rows)
    assert set(got) == {k[0] for k in want}
    for who, r in got.items():
        assert r.n_events == want[who, None][0]
        assert {t: x.n for t, x in r.by_type.items()} == {k[1]: v[0] for k, v in want.items() if k[0] == who and k[1] is not None}
        assert abs((r.sum_v or 0) - sum(x[5] or 0 for x in rows if x[1] == who)) < 1e-9


def test_empty_table(spark, tmp_path):
    s = store(spark, tmp_path / "s").build(spark.createDataFrame([(None, "a", None, None, 1, None, 1)], SCHEMA).where(F.lit(True)))
    assert s.update(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)) == []
