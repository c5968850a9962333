"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restrict_to_keys(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``big`` whose key appears in ``keys`` (a semi-join on the
    distinct keys).  No hint: the planner broadcasts the key set where its
    measured size in bytes allows (``spark.sql.autoBroadcastJoinThreshold``,
    again at run time by AQE), and shuffles otherwise."""
    return big.join(keys.select(*on).distinct(), list(on), "left_semi")


def zip_by_order(left: DataFrame, left_order: str, right: DataFrame, right_order: str,
                 name: str = "row_no") -> DataFrame:
    """Positional zip of two separately ordered inputs: the i-th row of
    ``left`` (by ``left_order``) next to the i-th row of ``right``.  Both
    sides get exact distributed ranks, then an equi-join on the rank."""
    from .ranks import rank_within
    a = rank_within(left, left_order, name=name)
    b = rank_within(right, right_order, name=name)
    return a.join(b, [name], "inner")
