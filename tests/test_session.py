"""Session helpers: shared folder, checkpoints."""

import os

from docloom import session as S


def test_shared_dir_and_checkpointed(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    d = S.shared_dir(spark, "x/y")
    assert d.startswith(base) and os.path.isdir(d)
    a, b = S.fresh_dir(spark, "runs"), S.fresh_dir(spark, "runs")
    assert a != b
    df = spark.range(10).selectExpr("id", "id * 2 AS v")
    c = S.checkpointed(df)
    assert c.count() == 10 and "ExistingRDD" in c._jdf.queryExecution().executedPlan().toString()


def test_materialized_is_read_back_from_the_shared_folder(spark):
    df = S.materialized(spark.range(10), "m")
    assert df.count() == 10 and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
