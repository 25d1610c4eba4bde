import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gitsift.functions import scoring as S
from gitsift.operators import profiles as P


def values(spark, xs, col):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(col(F.col("x"))).collect()]


def test_erf(spark):
    xs = [0, 1e-9, 0.1, 0.5, 1, 1.7, 2.5, 3.3, 4.2, 5.5, 6, 8, 30, -2.5]
    for x, y in zip(xs, values(spark, xs, S.erf_abs)):
        want = math.erfc(abs(x))
        assert y == pytest.approx(math.erf(abs(x)), abs=3e-16) or abs((1 - y) - want) <= max(2e-16, 1e-10 * want)
    assert values(spark, [30], S.erf_abs) == [1.0]


def test_contribution_is_not_clamped(spark):
    got = values(spark, [0, 0.5, 1, -3, 0.9], S.contribution)
    assert got == pytest.approx([1 - (1 - x) ** (1 / 15) for x in (0, 0.5, 1, -3, 0.9)])
    assert got[2] == 1 and got[3] < 0


def test_prob_or_any_order_and_saturation(spark):
    xs = [0.2, 0.0, 0.7, -0.1]
    one = spark.range(1).select(S.prob_or([F.lit(x) for x in xs]), S.prob_or([F.lit(x) for x in xs[::-1]]), S.prob_or([F.lit(1.0), F.lit(-5.0)])).first()
    assert one[0] == pytest.approx(one[1]) == pytest.approx(1 - 0.8 * 0.3 * 1.1)
    assert one[2] == 1


def test_tail_rarity(spark):
    got = values(spark, [0, None, 1, 10, 1000], lambda x: S.tail_rarity(x, F.lit(5.0), F.lit(2.0)))
    assert got == pytest.approx([0, 0, 0, 0.75, 1 - 0.005**2])


@pytest.mark.parametrize("sample", [[1, 2, 2, 5, 9, 100, 0], [4, 4, 4], [7], [0, 0], [3] * 50 + [900]])
def test_tail_fit_equals_polyfit(spark, sample):
    df = spark.createDataFrame([("r", x) for x in sample], "repo string, m int")
    got = P.tail_fits(P.metric_values(df, ["repo"], ["m"]), ["repo", "metric"]).first()
    p = np.array(sample + ([max(sample) + 1] if min(sample) == max(sample) else []), dtype=float)
    ecdf = np.array([(p <= x).mean() for x in p])
    slope, cut = np.polyfit(np.log(p + 1e-6), np.log(1 + 1e-6 - ecdf), 1)
    assert got.beta == pytest.approx(-slope, rel=1e-6)
    assert math.log(got.alpha) == pytest.approx(cut / -slope, rel=1e-6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60))
def test_ecdf_counts_ties(spark, xs):
    df = spark.createDataFrame([("k", float(x)) for x in xs], "k string, value double").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    for r in P.weighted_ecdf(df, ["k"]).collect():
        assert r.ecdf == pytest.approx(sum(x <= r.value for x in xs) / len(xs))
        assert 0 < r.ecdf <= 1


def test_ecdf_of_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1.0, 2), ("a", None, 5.0, 2), (None, None, 1.0, 1), ("a", "b", 1.0, 1)], "k string, m string, value double, n long")
    assert {(r.k, r.m, r.value): r.ecdf for r in P.weighted_ecdf(df, ["k", "m"]).collect()} == {("a", None, 1.0): 0.5, ("a", None, 5.0): 1.0, (None, None, 1.0): 1.0, ("a", "b", 1.0): 1.0}


def test_circular_rarity(spark):
    hours = [random.Random(1).randrange(24) for _ in range(30)] + [9] * 30
    hist = [hours.count(h) for h in range(24)]
    dens = [np.mean([math.exp(4 * math.cos((h - q) * 2 * math.pi / 24)) for h in hours]) for q in range(24)]
    df = spark.createDataFrame([(h, hist) for h in range(24)], "h int, hist array<long>")
    got = [r[0] for r in df.orderBy("h").select(S.circular_rarity(F.col("h"), S.circular_density(F.col("hist"), 24))).collect()]
    assert got == pytest.approx([1 - d / max(dens) for d in dens])


def test_normal_rarity_defaults(spark):
    df = spark.createDataFrame([(None, 9, 2.0), (3.0, 4, 2.0), (3.0, 9, 1.4), (3.0, 9, 2.0)], "x double, n long, sd double")
    got = [r[0] for r in df.select(S.normal_rarity(F.col("x"), F.col("n"), F.lit(0.0), F.col("sd"))).collect()]
    assert got == pytest.approx([0.5, 0.5, 0.5, math.erf(1.5 / math.sqrt(2))])


def test_flat_scores(spark):
    df = spark.createDataFrame([(True, 6, 10), (False, 6, 10), (None, 6, 10), (None, 5, 10), (None, 4, 4)], "s boolean, n long, t long")
    assert [r[0] for r in df.select(S.signing_score(F.col("s"), F.col("n"), F.col("t"))).collect()] == [0, 0.85, 0.85, 0, 0]
    df = spark.createDataFrame([(True, 0, 10), (True, 1, 10), (True, 2, 10), (False, 0, 10), (None, 0, 10), (True, 0, 4)], "s boolean, n long, t long")
    assert [r[0] for r in df.select(S.identity_score(F.col("s"), F.col("n"), F.col("t"))).collect()] == pytest.approx([0.35, 0.175, 0, 0, 0, 0])


def test_type_pairs_and_counts(spark):
    df = spark.createDataFrame([([".b", ".a", ".b", None],), ([],), (None,), ([".x"],)], "filetypes array<string>").withColumn("types", P.type_counts())
    rows = df.select("types", P.type_pairs().alias("p")).collect()
    assert [(t.t, t.c, t.place) for t in rows[0].types] == [(".a", 1, 2), (".b", 2, 1)]
    assert [(p.a, p.b) for p in rows[0].p] == [(".a", ".b")] and rows[0].p[0].ratio == pytest.approx(math.log10(0.5))
    assert [len(r.p) for r in rows] == [1, 0, 0, 0]
