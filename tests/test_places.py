"""Tokens to characters and back, against plain Python."""

import random

from pyspark.sql import functions as F

from docloom.functions import places as pl


def test_against_python(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        tokens = ["".join(rng.choice("ab 一😀") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 30))]
        first = rng.randrange(len(tokens))
        rows.append((i, tokens, first, rng.randint(first, len(tokens) - 1)))
    df = spark.createDataFrame(rows, "i int, tokens array<string>, first int, last int").withColumn("ends", pl.token_ends("tokens"))
    df = df.withColumn("chars", pl.chars_of_tokens(F.col("ends"), F.col("first"), F.col("last")))
    df = df.withColumn("back", pl.tokens_of_chars(F.col("ends"), F.col("chars.start"), F.col("chars.end")))
    for r in df.withColumn("t", pl.span_text(F.array_join("tokens", ""), F.col("chars"))).collect():
        assert r.ends == [len("".join(r.tokens[:k + 1])) for k in range(len(r.tokens))]
        assert r.t == "".join(r.tokens[r.first:r.last + 1])
        if not r.t:
            assert r.back is None
            continue
        owner = [k for k, x in enumerate(r.tokens) for _ in x]
        assert (r.back.first, r.back.last) == (owner[r.chars.start], owner[r.chars.end - 1])


def test_long_and_undefined(spark):
    long = spark.range(1).select(F.array_repeat(F.lit("ab"), 200_000).alias("tokens"))
    ends = long.select(pl.token_ends("tokens").alias("e"))
    got = ends.select(F.element_at("e", -1).alias("n"), pl.tokens_of_chars(F.col("e"), F.lit(250_001), F.lit(250_003)).alias("b")).first()
    assert got.n == 400_000 and tuple(got.b) == (125_000, 125_001)
    rows = spark.createDataFrame([(None, 0, 0), ([], 0, 0), (["a", None, "b"], 2, 1), (["a"], 0, 1), (["a"], -1, 0), (["a"], None, 0)],
                                 "tokens array<string>, f int, l int").coalesce(1)
    out = rows.select(pl.token_ends("tokens").alias("e"), "f", "l")
    out = out.select("e", pl.chars_of_tokens(F.col("e"), F.col("f"), F.col("l")).alias("c"),
                     pl.tokens_of_chars(F.col("e"), F.col("f"), F.col("l")).alias("b")).collect()
    assert [r.e for r in out] == [None, [], [1, 1, 2], [1], [1], [1]]
    assert [r.c for r in out] == [None] * 6
    assert [r.b and tuple(r.b) for r in out] == [None, None, None, (0, 0), None, None]
    assert rows.where("f > 9").select(pl.token_ends("tokens")).count() == 0
