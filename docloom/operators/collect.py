"""Collecting predictions into answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("qid", "category", "retrieve")


def distinct_predictions(df: DataFrame) -> DataFrame:
    """A3: full-row distinct (a partial/final hash aggregate)."""
    return df.dropDuplicates()


def best_predictions(df: DataFrame, keys: Sequence[str] = KEYS, metric: str = "incre_num_by",
                     by: Sequence[str] = ()) -> DataFrame:
    """A2: the row with the smallest ``metric`` per key.  Null keys are
    dropped first (pandas ``groupby`` drops them; Q26).  Duplicate rows need
    no distinct pass: ``min`` already ignores them."""
    k = list(by) + list(keys)
    return df.dropna(subset=list(keys)).groupBy(*k).agg(F.min(metric).alias(metric))


def collect_answers(df: DataFrame, keys: Sequence[str] = KEYS, metric: str = "incre_num_by",
                    by: Sequence[str] = ()) -> DataFrame:
    """A2+P11+O3: best prediction per (qid, category, retrieve), then
    ``qid``/``retrieve`` cast strictly to int and ``category``/metric dropped
    (one qid may keep several answers, Q8).  Sort at write time (O3)."""
    best = best_predictions(df, keys, metric, by)
    return best.select(*by, F.col("qid").cast("int").alias("qid"),
                       F.col("retrieve").cast("int").alias("retrieve"))


def best_answer_per_qid(df: DataFrame, metric: str = "incre_num_by", by: Sequence[str] = ()) -> DataFrame:
    """Q8 variant: one answer per qid — ``min_by`` on (metric, category, retrieve)."""
    order = F.struct(F.col(metric), F.col("category"), F.col("retrieve"))
    return (df.dropna(subset=["qid", "retrieve"])
            .groupBy(*by, "qid")
            .agg(F.min_by(F.struct("category", "retrieve", metric), order).alias("_b"))
            .select(*by, F.col("qid").cast("int").alias("qid"),
                    F.col("_b.retrieve").cast("int").alias("retrieve"),
                    F.col("_b.category").alias("category"), F.col(f"_b.{metric}").alias(metric)))


def sorted_answers(df: DataFrame) -> DataFrame:
    """O3: ascending qid, ties by retrieve (deterministic order for writing)."""
    return df.orderBy("qid", "retrieve")
