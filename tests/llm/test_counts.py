import math
import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gitsift.llm.cooccur import cooccurrence
from gitsift.llm.ngrams import mark_terms, ngram_counts
from gitsift.llm.quantiles import merge_sketches, percentiles, sketch
from gitsift.llm.queries import R

SAMPLES = [[1], [0, 0, 5], [-4.5, -1e-9, 0, 3, 1e12], list(range(1000)), [7] * 30 + [-7] * 31, [2.0**k for k in range(-40, 40)]]


@pytest.mark.parametrize("xs", SAMPLES)
def test_percentiles_are_within_the_bound(spark, xs):
    df = spark.createDataFrame([("k", float(x), 0) for x in xs] + [("k", None, 0), ("k", float("nan"), 0), ("k", float("inf"), 0), ("none", None, 0)], "k string, x double, n int")
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for alpha in (0.01, 0.2):
        rows = {r.p: r for r in percentiles(sketch(df, ["k"], ["x"], alpha), ["k"], ps, alpha).collect()}
        assert len(rows) == len(ps) and all(r.n == len(xs) and r.k == "k" for r in rows.values())
        for p in ps:
            true = sorted(xs)[math.floor(p * (len(xs) - 1))]
            assert abs(rows[p].value - true) <= alpha * abs(true) * (1 + 1e-9)


def test_merging_parts_is_exact(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.choice("ab"), r.choice("xyz"), r.gauss(0, 100)) for _ in range(400)], "k string, day string, v double")
    daily = sketch(df, ["k", "day"], ["v"])
    whole = {tuple(x) for x in sketch(df, ["k"], ["v"]).collect()}
    assert {tuple(x) for x in merge_sketches(daily, ["k"]).collect()} == whole
    assert {tuple(x) for x in merge_sketches(merge_sketches(daily, ["k", "day"]).unionByName(daily.limit(0)), ["k"]).collect()} == whole


def test_empty_sketch(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert percentiles(sketch(df, ["k"], ["v"]), ["k"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        sketch(df, ["k"], ["v"], 1.0)


def pairs_by_hand(baskets):
    n, one, two = len(baskets), Counter(), Counter()
    for b in baskets:
        s = sorted({x for x in b or [] if x is not None}, key=lambda x: x.encode())
        one.update(s)
        two.update(combinations(s, 2))
    return {k: (c, one[k[0]], one[k[1]], n) for k, c in two.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", ".é", ".Z", "", None, "zz"]), max_size=6)), max_size=25))
def test_pairs(spark, baskets):
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, n int")
    got = {(r.item_a, r.item_b): r for r in cooccurrence(df, "items").collect()}
    want = pairs_by_hand(baskets)
    assert {k: (r.n_ab, r.n_a, r.n_b, r.n) for k, r in got.items()} == want
    for k, (ab, a, b, n) in want.items():
        assert got[k].lift == pytest.approx(ab * n / (a * b)) and got[k].pmi == pytest.approx(math.log(ab * n / (a * b)))
    assert {(r.item_a, r.item_b) for r in cooccurrence(df, "items", 2).collect()} == {k for k, v in want.items() if v[0] >= 2}


def test_pairs_of_a_single_commit_come_out(spark, tmp_path):
    rows = [("s1", ["py", "rs", "py"]), ("s1", ["py", "rs", "py"]), *[(f"t{i}", ["py", "js"]) for i in range(5)], ("u", None), (None, ["py", "go"])]
    spark.createDataFrame(rows, "sha string, filetypes array<string>").write.parquet(str(tmp_path / "commits.parquet"))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.lift) for r in R.queries["p5_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("py", "rs"): (1, 6, 1, 7 / 6), ("js", "py"): (5, 5, 6, 5 * 7 / 30)}
    assert [(r.item_a, r.item_b) for r in R.queries["p5_filetype_lift"](spark, str(tmp_path)).collect()] == [("js", "py")]


def grams_by_hand(records, max_n):
    tf, df = Counter(), Counter()
    for r in records:
        t = [x for x in r or [] if x is not None]
        g = [tuple(t[i : i + n]) for n in range(1, max_n + 1) for i in range(len(t) - n + 1)]
        tf.update(g)
        df.update(set(g))
    return {g: (c, df[g]) for g, c in tf.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c", "é", "", None]), max_size=12)), max_size=12), st.one_of(st.none(), st.integers(1, 4)))
def test_ngrams(spark, records, max_n):
    df = spark.createDataFrame([(r, "x") for r in records], "tokens array<string>, tf string").repartition(3)
    got = {tuple(r.ngram): (r.tf, r.df) for r in ngram_counts(df, "tokens", max_n).collect()}
    assert got == grams_by_hand(records, max_n or 12)


def test_ngrams_by_key_across_partitions(spark):
    r = random.Random(9)
    rows = [(r.choice(["f", "g", None]), [r.choice("abcde") * r.randrange(1, 3) for _ in range(r.randrange(0, 40))]) for _ in range(120)]
    df = spark.createDataFrame(rows, "field string, tokens array<string>").repartition(4)
    got = {}
    for x in ngram_counts(df, "tokens", 3, ["field"]).collect():
        assert (x.field, tuple(x.ngram)) not in got
        got[x.field, tuple(x.ngram)] = (x.tf, x.df)
    want = {(k, g): c for k in ("f", "g", None) for g, c in grams_by_hand([t for f, t in rows if f == k], 3).items()}
    assert got == want


def test_runs_of_some_lengths_and_counts(spark):
    r = random.Random(2)
    records = [[r.choice("ab") for _ in range(r.randrange(0, 30))] for _ in range(40)] + [["a"] * 70, ["b", "a"] * 33]
    df = spark.createDataFrame([(x,) for x in records], "tokens array<string>").repartition(4)
    want = grams_by_hand(records, 70)
    for low, high, least in ((1, None, 1), (3, None, 2), (2, 5, 1), (1, 1, 3)):
        got = {tuple(x.ngram): (x.tf, x.df) for x in ngram_counts(df, "tokens", None, None, low, high, least).collect()}
        assert got == {g: c for g, c in want.items() if low <= len(g) <= (high or 99) and c[0] >= least}
    got = {tuple(x.ngram): (x.tf, x.df) for x in ngram_counts(df, "tokens", 6, None, 2, 6, 2).collect()}
    assert got == {g: c for g, c in want.items() if 2 <= len(g) <= 6 and c[0] >= 2}


def test_a_large_basket_is_no_single_row(spark):
    """Pairs are made after the places of the basket are rows, and once."""
    df = spark.createDataFrame([([f"i{k:04}" for k in range(700)],), (["i0001", "i0002"],)], "items array<string>")
    got = cooccurrence(df, "items")
    assert got.count() == 700 * 699 // 2
    assert [(x.n_ab, x.n_a, x.n_b, x.n) for x in got.where("item_a = 'i0001' and item_b = 'i0002'").collect()] == [(2, 2, 2, 2)]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_long_record_and_marks(spark):
    tokens = [str(i % 7) for i in range(20000)] + ["once"]
    df = spark.createDataFrame([(tokens,), (["once"],), ([],), (None,), (["other"],)], "tokens array<string>")
    counts = ngram_counts(df, "tokens", 2)
    n = df.agg(F.count(F.lit(1)))
    marks = {tuple(r.ngram): (r.tf, r.df, r.mark) for r in mark_terms(counts, n, 1, 2, 5).collect() if len(r.ngram) == 1}
    assert marks[("once",)] == (2, 2, "common") and marks[("3",)] == (2857, 1, "rare") and marks[("other",)] == (1, 1, "rare")
    assert len(marks) == 9
