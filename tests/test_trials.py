"""Trial analysis: Pareto set vs brute force, log metric parsing, run ids."""

import math
import random

from docloom.operators import trials as tr


def brute_front(pts):
    return sorted(i for i, (a, b) in enumerate(pts)
                  if not any(a2 <= a and b2 <= b and (a2 < a or b2 < b) for a2, b2 in pts))


def test_pareto_golden(spark):
    pts = [(1, 5), (2, 2), (3, 3), (1, 5)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    got = sorted(r.id for r in tr.pareto_front(df, {"a": "min", "b": "min"}).collect())
    assert got == [0, 1, 3]


def test_pareto_random(spark):
    rng = random.Random(2)
    for trial in range(3):
        pts = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(300)]
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                                   "id long, a double, b double")
        got = sorted(r.id for r in tr.pareto_front(df, {"a": "min", "b": "min"}, n_buckets=6).collect())
        assert got == brute_front(pts)
    # max direction = min of the negation
    got = sorted(r.id for r in tr.pareto_front(df, {"a": "max", "b": "min"}).collect())
    assert got == brute_front([(-a, b) for a, b in pts])


def test_log_metrics(spark):
    lines = [(1, 0, "start"), (1, 1, "{'eval_loss': nan, 'eval_precision': 1, 'eval_recall': 0, 'ok': True}"),
             (2, 0, "{'eval_loss': 0.5, 'eval_precision': 1, 'eval_recall': 0, 'eval_samples_per_second': 3.0}"),
             (2, 1, "{'eval_loss': 0.25, 'eval_precision': 1, 'eval_recall': 0, 'eval_samples_per_second': 4.0}"),
             (3, 0, "{'loss': 1}")]
    df = spark.createDataFrame(lines, "trial_id long, line_no long, line string")
    got = {r.trial_id: r for r in tr.metrics_from_logs(df).collect()}
    assert math.isnan(got[1].eval_loss) and got[1].state == "complete"
    assert (got[2].eval_loss, got[2].eval_samples_per_second) == (0.25, 4.0)
    assert got[3].eval_loss is None and got[3].state == "pruned"


def test_run_id(spark):
    import hashlib
    import json
    cfg = {"b": "1", "a": "2"}
    df = spark.createDataFrame([(cfg,)], "m map<string,string>")
    expect = hashlib.sha256(json.dumps(cfg, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(tr.run_id("m")).first()[0] == expect


def test_attributes_and_append(spark, tmp_dir):
    df = spark.createDataFrame([(1, 0.5)], "trial_id long, a double")
    tr.append_trials(tr.with_attributes(df, {"contributors": "x"}), tmp_dir, "s1")
    tr.append_trials(df.withColumn("trial_id", df.trial_id + 1), tmp_dir, "s1")
    back = spark.read.option("mergeSchema", True).parquet(tmp_dir)
    assert back.count() == 2 and set(back.columns) >= {"study", "trial_id", "attrs"}
