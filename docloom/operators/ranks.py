"""Exact row ranks and running aggregates without a single-task window.

``row_number()`` over a low-cardinality (or empty) partition key sends a whole
class, or the whole table, through one task.  Here rows are range-partitioned
and sorted by (group, order) once and written to the shared folder; a group
that holds a third of all rows is spread over many partitions.  A small table,
one row per (partition, group), holds counts and their prefix sums; a row's
rank is its place in its partition plus that offset.

NULL group keys are a group of their own and NULL order values sort first
(last when descending): every input row comes back.  Ties in the order value
are numbered in some order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

PLACE, PART = "_rk_m", "_rk_part"


def range_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on the ``on`` columns in which NULLs are equal too; the
    columns of ``left``, then the further ones of ``right``."""
    named = {c: f"_ns_{i}" for i, c in enumerate(on)}
    right = right.select(*[F.col(c).alias(named.get(c, c)) for c in right.columns])
    cond = F.lit(True)
    for c, other in named.items():
        cond = cond & F.col(c).eqNullSafe(F.col(other))
    return left.join(right, cond, how).drop(*named.values())


def sorted_once(df: DataFrame, order: Column, partition_by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by (group, order), with its place
    (``PLACE``, increasing) and partition (``PART``); read once, written once."""
    by = [*[F.col(k) for k in partition_by], order]
    return materialized(df.repartitionByRange(parts or range_partitions(df), *by).sortWithinPartitions(*by)
                        .withColumn(PLACE, F.monotonically_increasing_id())
                        .withColumn(PART, F.shiftright(PLACE, 33)), "ranks")


def group_offsets(rows: DataFrame, partition_by: Sequence[str], *extra: Column) -> DataFrame:
    """A row per (partition, group): ``_rk_first`` place, ``_rk_n`` rows and
    ``_rk_off``, the group's rows in earlier partitions."""
    per = rows.groupBy(PART, *partition_by).agg(F.min(PLACE).alias("_rk_first"), F.count(F.lit(1)).alias("_rk_n"), *extra)
    before = Window.partitionBy(*partition_by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_rk_off", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)))


def with_offsets(rows: DataFrame, offsets: DataFrame, partition_by: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the rank ``name`` and the further columns of ``offsets``."""
    rank = (F.col(PLACE) - F.col("_rk_first") + F.col("_rk_off")).cast("long")
    return (join_null_safe(rows.drop(name), offsets, [PART, *partition_by])
            .withColumn(name, rank).drop(PLACE, PART, "_rk_first", "_rk_n", "_rk_off"))


def rank_within(df: DataFrame, order_col: str, partition_by: Sequence[str] = (),
                name: str = "rank", n_buckets: int | None = None,
                descending: bool = False) -> DataFrame:
    """0-based rank of each row inside ``partition_by`` by ``order_col``;
    ``n_buckets`` sets the number of range partitions."""
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    rows = sorted_once(df, order, partition_by, n_buckets)
    return with_offsets(rows, group_offsets(rows, partition_by), partition_by, name)


def running_within(df: DataFrame, value: str, order_col: str, partition_by: Sequence[str] = (),
                   how: str = "max", name: str = "running", inclusive: bool = True,
                   n_buckets: int | None = None) -> DataFrame:
    """Running ``max``/``min``/``sum`` of ``value`` in ``order_col`` order inside
    ``partition_by`` (up to and including the row, or strictly before it with
    ``inclusive=False``).

    Each (partition, group) has its aggregate carried forward to the later
    ones; the window itself runs inside (partition, group) only.
    ``order_col`` should be unique inside a group for the exclusive form."""
    fn = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    rows = sorted_once(df, F.col(order_col).asc(), partition_by, n_buckets)
    keys = [PART, *partition_by]
    per = rows.groupBy(*keys).agg(fn(value).alias("_ru_b"))
    before = Window.partitionBy(*partition_by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, fn("_ru_b").over(before).alias("_ru_carry"))
    inside = Window.partitionBy(*keys).orderBy(PLACE).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    rows = rows.withColumn("_ru_in", fn(value).over(inside))
    if how == "sum":
        combined = F.coalesce(F.col("_ru_carry"), F.lit(0)) + F.coalesce(F.col("_ru_in"), F.lit(0))
    else:
        combined = (F.greatest if how == "max" else F.least)(F.col("_ru_carry"), F.col("_ru_in"))
    kept = [c for c in df.columns if c != name]
    return join_null_safe(rows, carry, keys).select(*kept, combined.alias(name))


def running_max_within(df: DataFrame, value: str, order_col: str, partition_by: Sequence[str] = (),
                       name: str = "running_max", n_buckets: int | None = None) -> DataFrame:
    """Inclusive running max (see ``running_within``)."""
    return running_within(df, value, order_col, partition_by, "max", name, True, n_buckets)
