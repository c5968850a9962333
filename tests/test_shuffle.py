"""Keyed permutations of positions: bijection, inverse, epochs, single steps."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import shuffle as sh


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_bijection_and_inverse(spark, n):
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("epoch"), F.lit(n).cast("long").alias("n"))
    there = rows.withColumn("at", sh.permuted(F.col("id"), F.col("n"), F.lit(5), F.col("epoch")))
    back = there.withColumn("back", sh.permuted(F.col("at"), F.col("n"), F.lit(5), F.col("epoch"), inverse=True)).collect()
    for e in range(3):
        assert sorted(r.at for r in back if r.epoch == e) == list(range(n))
    assert all(r.back == r.id for r in back)
    if n == 1000:  # epochs have orders of their own, far from the given one
        orders = [[r.at for r in sorted(back, key=lambda r: r.id) if r.epoch == e] for e in range(3)]
        assert all(sum(a == b for a, b in zip(orders[i], orders[j], strict=True)) < 20 for i, j in ((0, 1), (1, 2), (0, 2)))
        assert sum(x == i for i, x in enumerate(orders[0])) < 20
        assert sum(abs(a - b) < 10 for a, b in zip(orders[0], orders[0][1:], strict=False)) < 60


def test_large_n_stays_exact(spark):
    n = (1 << 60) + 12345
    x = spark.createDataFrame([(0,), (1,), (n // 2,), (n - 1,)], "x long").withColumn("n", F.lit(n))
    there = x.withColumn("at", sh.permuted(F.col("x"), F.col("n"), F.lit(1), F.lit(0)))
    back = there.withColumn("back", sh.permuted(F.col("at"), F.col("n"), F.lit(1), F.lit(0), inverse=True)).collect()
    assert all(0 <= r.at < n and r.back == r.x for r in back) and len({r.at for r in back}) == 4


def test_undefined_places(spark):
    x = spark.createDataFrame([(0, 0, 1), (-1, 5, 1), (5, 5, 1), (None, 5, 1), (2, 5, None)], "x long, n long, seed long")
    assert [r.at for r in x.select(sh.permuted(F.col("x"), F.col("n"), F.col("seed"), F.lit(0)).alias("at")).collect()] == [None] * 5


def test_epochs_on_any_partitioning_and_single_steps(spark):
    items = spark.createDataFrame([(i, f"t{i}") for i in range(101)], "id long, t string")
    whole = {r.step: (r.epoch, r.id) for r in sh.shuffled_epochs(items, "id", 3, seed=9).collect()}
    again = {r.step: (r.epoch, r.id) for r in sh.shuffled_epochs(items.repartition(17), "id", 3, seed=9).collect()}
    assert whole == again and sorted(whole) == list(range(303))
    some = {r.step: (r.epoch, r.id) for r in sh.steps_between(items, "id", 95, 210, seed=9).collect()}
    assert some == {s: whole[s] for s in range(95, 210)}
    empty = items.where("id < 0")
    assert sh.shuffled_epochs(empty, "id", 3).count() == 0 and sh.steps_between(empty, "id", 0, 5).count() == 0
