"""Linear subsequence search against slices."""

import random
import time

from pyspark.sql import functions as F

from docloom.functions import search
from docloom.functions import spans as sp


def test_occurrences_equal_slices():
    draw = random.Random(2)
    for _ in range(400):
        t = [draw.randint(0, 2) for _ in range(draw.randint(0, 30))]
        g = [draw.randint(0, 2) for _ in range(draw.randint(0, 5))]
        assert search.occurrences(t, g) == [i for i in range(len(t) - len(g) + 1) if g and t[i:i + len(g)] == g]


def test_columns_on_nulls_short_and_long_texts(spark):
    rows = [(1, ["a", "b", "a", "b", "a"], ["a", "b", "a"]), (2, ["a"], ["a"]), (3, [], ["a"]), (4, ["a"], []), (5, None, ["a"]), (6, ["a"], None),
            (7, ["a", None, "b", "a", None, "b"], ["a", None, "b"]), (8, [None, "a"], [None]), (9, ["a", "b"], ["a", "b", "c"]), (10, ["é", "中"], ["中"])]
    df = spark.createDataFrame(rows, "k int, t array<string>, g array<string>").repartition(3)
    got = {r.k: (r.f, r.m) for r in df.select("k", sp.find_subsequence("t", "g").alias("f"), sp.match_mask("t", "g").alias("m")).collect()}
    starts = {k: list(f.starts) if f.found else [] for k, (f, _) in got.items()}
    assert starts == {1: [0, 2], 2: [0], 3: [], 4: [], 5: [], 6: [], 7: [0, 3], 8: [], 9: [], 10: [1]}
    assert {k: m for k, (_, m) in got.items()} == {1: [True] * 5, 2: [True], 3: [], 4: [False], 5: None, 6: [False], 7: [True] * 6, 8: [False] * 2, 9: [False] * 2,
                                                   10: [False, True]}


def test_many_equal_words_take_linear_time(spark):
    df = spark.range(1).select(F.array_repeat(F.lit("w"), 100_000).alias("t"), F.array_repeat(F.lit("w"), 500).alias("g"))
    begin = time.perf_counter()
    row = df.select(F.size(sp.find_subsequence("t", "g")["starts"]).alias("n"), F.size(F.filter(sp.match_mask("t", "g"), lambda x: x)).alias("m")).first()
    assert (row.n, row.m) == (100_000 - 499, 100_000) and time.perf_counter() - begin < 20
