import random

from pyspark.sql import functions as F

from gitsift.operators.eager import eager_join_aggregate, heavy_keys, roll_up

SCHEMA = "k string, g string, x long, same int"


def data(spark, seed, n):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice(["a", "a", "a", "b", "c", None, "only" + str(seed)]), r.choice("uv"), r.choice([None, r.randrange(9)]), 1) for _ in range(n)], SCHEMA)


def test_inner_equals_join(spark):
    a, b = data(spark, 1, 60), data(spark, 2, 50)
    got = {r.k: r for r in roll_up(eager_join_aggregate(a, b, ["k", "g"], ["x"], ["x"]), ["k"]).collect()}
    j = a.alias("a").join(b.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.g") == F.col("b.g")))
    want = j.groupBy("a.k").agg(F.count(F.lit(1)).alias("n"), F.sum("a.x").alias("l"), F.sum("b.x").alias("r")).collect()
    assert len(got) == len(want) > 0
    for w in want:
        assert (got[w.k].join_rows, got[w.k].sum_x_left, got[w.k].sum_x_right) == (w.n, w.l, w.r)


def test_full_keeps_unmatched_and_null_keys(spark):
    a, b = data(spark, 1, 60), data(spark, 2, 50)
    rows = eager_join_aggregate(a, b, ["k"], ["x"], ["x"], "full").collect()
    assert sum(r.n_left for r in rows) == 60 and sum(r.n_right for r in rows) == 50
    want = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"), "full").count()
    assert sum(r.join_rows for r in rows) == want
    assert sum(r.k is None for r in rows) == 2


def test_empty_sides(spark):
    a, none = data(spark, 1, 20), spark.createDataFrame([], SCHEMA)
    assert eager_join_aggregate(a, none, ["k"], ["x"], ["x"]).count() == 0
    assert eager_join_aggregate(none, none, ["k"], [], [], "full").count() == 0
    assert sum(r.n_left for r in eager_join_aggregate(a, none, ["k"], [], [], "full").collect()) == 20
    assert heavy_keys(eager_join_aggregate(none, none, ["k"], how="full"), "n_left", 1, 2).count() == 0


def test_heavy_keys_are_exact_at_the_border(spark):
    states = spark.createDataFrame([("a", 2), ("b", 1), ("c", 97), ("d", 0)], "k string, n long")
    assert {r.k for r in heavy_keys(states, "n", 2, 100).collect()} == {"a", "c"}


def test_one_hot_key_sends_one_row_a_task(spark):
    hot = spark.range(0, 20000, numPartitions=4).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
    r = eager_join_aggregate(hot, hot, ["k"], ["x"], []).first()
    assert r.join_rows == 20000**2 and r.sum_x_left == sum(range(20000)) * 20000
