"""Tuning-trial analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import running_within

# Markers a metrics line must contain, and the Python-literal
# tokens rewritten to JSON before parsing.
METRIC_MARKERS = ("eval_loss", "eval_precision", "eval_recall")
PY_LITERALS = (("nan", "NaN"), ("None", "null"), ("True", "true"), ("False", "false"))


def python_literal_to_json(line) -> Column:
    """F19 prep: ``nan/None/True/False`` → ``NaN/null/true/false`` (word-bounded);
    single quotes are accepted by Spark's JSON reader as they are."""
    c = F.col(line) if isinstance(line, str) else line
    for a, b in PY_LITERALS:
        c = F.regexp_replace(c, f"\\b{a}\\b", b)
    return c


def parse_metrics(line) -> Column:
    """a dict literal line → ``map<string,string>`` (values as raw text;
    cast the ones you need with ``try_cast``)."""
    return F.from_json(python_literal_to_json(line), "map<string,string>",
                       {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"})


def metrics_from_logs(logs: DataFrame, trial: str = "trial_id", line_no: str = "line_no",
                      line: str = "line", markers: Sequence[str] = METRIC_MARKERS,
                      objectives: Sequence[str] = ("eval_loss", "eval_samples_per_second")) -> DataFrame:
    """Per trial, the last line containing every marker, parsed;
    a trial with no such line or no ``eval_loss`` is ``pruned``.  Every
    trial in ``logs`` appears once."""
    cond = F.lit(True)
    for m in markers:
        cond = cond & F.col(line).contains(m)
    last = (logs.groupBy(trial)
            .agg(F.max_by(F.when(cond, F.col(line)), F.when(cond, F.col(line_no))).alias("_line")))
    parsed = last.withColumn("_m", parse_metrics("_line"))
    # non-finite numbers come back as quoted text ("NaN"): unquote, then cast
    val = lambda o: F.regexp_replace(F.col("_m")[o], r'^"(.*)"$', "$1").try_cast("double")
    out = parsed.select(trial, *[val(o).alias(o) for o in objectives])
    return out.withColumn("state", F.when(F.col(objectives[0]).isNull(), F.lit("pruned"))
                          .otherwise(F.lit("complete")))


def pareto_front(df: DataFrame, objectives: Mapping[str, str], n_buckets: int | None = None) -> DataFrame:
    """H5: rows not dominated on two objectives (``'min'`` or ``'max'`` each).

    Scalable skyline: with objectives (a, b) both minimised, a row survives
    iff b equals the smallest b at its a, and b is below the smallest b of
    every strictly smaller a: a running minimum over the distinct values of
    a (``running_within``).  No self-join, no single-task window.  Duplicated rows are all
    kept (neither dominates the other)."""
    (a, da), (b, db) = list(objectives.items())
    sa = F.col(a) if da == "min" else -F.col(a)
    sb = F.col(b) if db == "min" else -F.col(b)
    pts = df.select(sa.alias("_pa"), sb.alias("_pb")).where(F.col("_pa").isNotNull() & F.col("_pb").isNotNull())
    # one row per distinct first objective
    per_a = pts.groupBy("_pa").agg(F.min("_pb").alias("_mb"))
    front = (running_within(per_a, "_mb", "_pa", how="min", name="_prev", inclusive=False, n_buckets=n_buckets)
             .where(F.col("_prev").isNull() | (F.col("_mb") < F.col("_prev")))
             .select("_pa", F.col("_mb").alias("_pb")))
    return (df.withColumn("_pa", sa).withColumn("_pb", sb)
            .join(front, ["_pa", "_pb"], "left_semi")
            .drop("_pa", "_pb"))


def run_id(params) -> Column:
    """SHA-256 of the key-sorted compact JSON of a ``map<string,string>``."""
    m = F.col(params) if isinstance(params, str) else params
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), 256)


def with_attributes(df: DataFrame, attrs: Mapping[str, str], name: str = "attrs") -> DataFrame:
    """H7: per-study attributes as a map column."""
    kv = []
    for k, v in attrs.items():
        kv += [F.lit(k), F.lit(v)]
    return df.withColumn(name, F.create_map(*kv))


def append_trials(df: DataFrame, path: str, study: str) -> None:
    """H6: append trials to a table keyed by (study, trial_id), partitioned
    by study so a resumed study only adds files.  Appends may add columns;
    read the table back with ``read_trials``, which counts a trial once even
    where an append was tried again."""
    (df.withColumn("study", F.lit(study))
     .write.mode("append").partitionBy("study").parquet(path))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """H6: the appended trials, one row for each (study, trial_id)."""
    return spark.read.option("mergeSchema", True).parquet(path).dropDuplicates(["study", "trial_id"])
