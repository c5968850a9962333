"""Splits and feeding: stratified k-fold, batches, epochs, seeded shuffle, slices
(W1, W5, W6, O1-O6, A5, A7, U4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .ranks import group_offsets, join_null_safe, rank_within, running_within, sorted_once, with_offsets


def stratified_folds(df: DataFrame, strata: str, order: str, k: int = 5,
                     name: str = "fold", n_buckets: int | None = None) -> DataFrame:
    """Stratified k-fold without shuffling (the usual library semantics).

    Classes are numbered by first appearance (min of ``order``); class c
    owns positions [off_c, off_c + n_c) of the label-sorted list and fold i
    takes, from class c, as many rows as there are positions ≡ i (mod k) in
    that range.  The j-th row of a class (by ``order``) goes to the first fold
    whose cumulative quota exceeds j.  The input is sorted once; class sizes
    and offsets come from the small (partition, class) table and ride on it to
    the rows.  NULL strata are a class; its rows are kept."""
    rows = sorted_once(df, F.col(order).asc(), [strata], n_buckets)
    per = materialized(group_offsets(rows, [strata], F.min(order).alias("_kf_first")), "folds")
    cls = per.groupBy(strata).agg(F.min("_kf_first").alias("_kf_first"), F.sum("_rk_n").alias("_kf_n"))
    # class offsets: exclusive prefix sum of class sizes in first-appearance order
    cls = running_within(cls, "_kf_n", "_kf_first", how="sum", name="_kf_off", inclusive=False).select(strata, "_kf_n", "_kf_off")
    per = join_null_safe(per.drop("_kf_first"), cls, [strata])
    off, n, j = F.col("_kf_off"), F.col("_kf_n"), F.col("_kf_j")
    # rows of fold i in class c: #{p in [off, off+n) : p ≡ i mod k}
    quota = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda i: F.floor((off + n - 1 - i + k) / k) - F.floor((off - 1 - i + k) / k))
    cum = F.transform(F.sequence(F.lit(1), F.lit(k)),
                      lambda m: F.aggregate(F.slice(quota, 1, m), F.lit(0).cast("long"),
                                            lambda acc, x: acc + x))
    fold = F.size(F.filter(cum, lambda c: c <= j))
    return (with_offsets(rows, per, [strata], "_kf_j")
            .withColumn(name, fold.cast("int"))
            .drop("_kf_off", "_kf_n", "_kf_j"))


def fold_split(df: DataFrame, fold: int, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    """U4: (train, test) for one fold id."""
    return df.where(F.col(name) != fold), df.where(F.col(name) == fold)


def class_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per class (or per class and fold)."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def batch_numbers(df: DataFrame, order: str, size: int, name: str = "batch_no",
                  descending: bool = False, n_buckets: int | None = None) -> DataFrame:
    """``batch_no = floor(rank / size)`` over an explicit order, plus the
    row's position inside its batch."""
    r = rank_within(df, order, name="_bn_rank", descending=descending, n_buckets=n_buckets)
    return (r.withColumn(name, F.floor(F.col("_bn_rank") / size).cast("long"))
            .withColumn("pos_in_batch", (F.col("_bn_rank") % size).cast("long"))
            .drop("_bn_rank"))


#: Rows that a slice may gather in one task.
TOP_ROWS = 10_000


def row_positions(df: DataFrame, order: str, name: str = "row_no",
                  descending: bool = False) -> DataFrame:
    """Explicit 0-based row numbers (never ``monotonically_increasing_id``)."""
    return rank_within(df, order, name=name, descending=descending)


def slice_rows(df: DataFrame, order: str, start: int = 0, end: int | None = None,
               descending: bool = True, name: str = "position") -> DataFrame:
    """O1+O2: rows ``[start, end)`` of ``df`` sorted by ``order`` (descending by
    default, as the reference sorts by qid descending), with their position.
    With an ``end`` of at most ``TOP_ROWS`` only the first ``end`` rows of the
    order are looked at (a top-k of each partition, merged); else ranks are
    distributed, so a slice deep in the table passes through no single task."""
    if end is not None and end <= TOP_ROWS:
        df = df.orderBy(F.col(order).desc() if descending else F.col(order).asc()).limit(end)
    ranked = row_positions(df, order, name=name, descending=descending).where(F.col(name) >= start)
    return ranked if end is None else ranked.where(F.col(name) < end)


def slice_then_sort(df: DataFrame, position: str, start: int, end: int | None, order: str,
                    descending: bool = True, name: str = "position") -> DataFrame:
    """O2 the other way round: rows ``[start, end)`` as they stand (by
    ``position``), then sorted by ``order`` and numbered in that order."""
    part = slice_rows(df, position, start, end, descending=False, name="_sl_pos").drop("_sl_pos")
    return row_positions(part, order, name=name, descending=descending)


def epoch_replay(df: DataFrame, order: str, epochs: int, name: str = "step") -> DataFrame:
    """The endless modulo iterator made finite: each row once per epoch,
    ``step = epoch * n + row_no``."""
    r = row_positions(df, order, name="_ep_row")
    total = df.select(F.count(F.lit(1))).scalar()  # scalar subquery: stays in the plan
    return (r.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
            .withColumn(name, F.col("epoch") * total + F.col("_ep_row"))
            .drop("_ep_row"))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "shuffle_key") -> DataFrame:
    """A deterministic shuffle order: the MD5 of ``key:seed`` in
    hexadecimal (a NULL key counts as ''), independent of partitioning and of
    the engine, unlike ``rand(seed)``."""
    return df.withColumn(name, F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")))


def first_row(df: DataFrame, order: str) -> DataFrame:
    """The first example by an explicit order."""
    return df.orderBy(order).limit(1)
