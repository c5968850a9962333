"""Registered queries: trial logs, Pareto fronts and run ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trials as tr
from . import oracle as O
from . import tables as TB
from .registry import register


# ---------------------------------------------------------------- trials

@register("trial_pareto", O.with_(O.TRIALS) + """
SELECT t.trial_id, t.a, t.b FROM trials t
WHERE t.state = 'complete' AND NOT EXISTS (
  SELECT 1 FROM trials u WHERE u.state = 'complete' AND u.a <= t.a AND u.b <= t.b AND (u.a < t.a OR u.b < t.b))""")
def trial_pareto(spark, d):
    t = TB.trials(spark, d).where(F.col("state") == "complete")
    return tr.pareto_front(t, {"a": "min", "b": "min"}).select("trial_id", "a", "b")


def trial_logs(spark, d):
    """part → rendered trial log lines (trial_id, line_no, line)."""
    p = TB.table(spark, d, "part")
    metrics = F.concat(F.lit("{'eval_loss': "), F.col("p_size").cast("string"),
                       F.lit(", 'eval_precision': 1, 'eval_recall': 0, 'eval_samples_per_second': "),
                       (F.col("p_partkey") % 13).cast("string"), F.lit(", 'ok': True, 'note': None}"))
    second = F.concat(F.lit("{'eval_loss': "), (F.col("p_size") + 1).cast("string"),
                      F.lit(", 'eval_precision': 0, 'eval_recall': 1, 'eval_samples_per_second': "),
                      (F.col("p_partkey") % 11).cast("string"), F.lit("}"))
    lines = F.array(F.concat(F.lit("trial "), F.col("p_partkey").cast("string"), F.lit(" start")),
                    F.concat(F.lit("{'loss': "), F.col("p_size").cast("string"), F.lit("}")),
                    F.when(F.col("p_partkey") % 7 != 0, metrics),
                    F.when(F.col("p_partkey") % 5 == 0, second))
    return p.select(F.col("p_partkey").alias("trial_id"), F.posexplode(lines).alias("line_no", "line")) \
        .where(F.col("line").isNotNull())


@register("trial_log_metrics", """WITH lines AS (
  SELECT p_partkey AS trial_id, 0 AS line_no, 'trial ' || CAST(p_partkey AS VARCHAR) || ' start' AS line FROM part
  UNION ALL SELECT p_partkey, 1, '{''loss'': ' || CAST(p_size AS VARCHAR) || '}' FROM part
  UNION ALL SELECT p_partkey, 2, '{''eval_loss'': ' || CAST(p_size AS VARCHAR) || ', ''eval_precision'': 1, ''eval_recall'': 0, ''eval_samples_per_second'': '
            || CAST(p_partkey % 13 AS VARCHAR) || ', ''ok'': True, ''note'': None}' FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT p_partkey, 3, '{''eval_loss'': ' || CAST(p_size + 1 AS VARCHAR) || ', ''eval_precision'': 0, ''eval_recall'': 1, ''eval_samples_per_second'': '
            || CAST(p_partkey % 11 AS VARCHAR) || '}' FROM part WHERE p_partkey % 5 = 0),
last AS (
  SELECT trial_id, arg_max(line, line_no) FILTER (WHERE contains(line, 'eval_loss') AND contains(line, 'eval_precision') AND contains(line, 'eval_recall')) AS line
  FROM lines GROUP BY trial_id),
j AS (SELECT trial_id, replace(replace(replace(line, '''', '"'), 'True', 'true'), 'None', 'null') AS js FROM last)
SELECT trial_id, CAST(json_extract_string(js, '$.eval_loss') AS DOUBLE) AS eval_loss,
       CAST(json_extract_string(js, '$.eval_samples_per_second') AS DOUBLE) AS eval_samples_per_second,
       CASE WHEN json_extract_string(js, '$.eval_loss') IS NULL THEN 'pruned' ELSE 'complete' END AS state
FROM j""")
def trial_log_metrics(spark, d):
    return tr.metrics_from_logs(trial_logs(spark, d))


@register("run_id", """SELECT p_partkey AS trial_id,
  sha256('{"brand":"' || p_brand || '","size":"' || CAST(p_size AS VARCHAR) || '","type":"' || p_type || '"}') AS run_id
FROM part""")
def run_id(spark, d):
    p = TB.table(spark, d, "part")
    params = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"),
                          F.lit("brand"), F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("trial_id"), tr.run_id(params).alias("run_id"))
