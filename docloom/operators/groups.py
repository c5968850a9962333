"""Work per group that no single task has to hold: a callback over batches of a
group's rows with a state that merges (X3), and ordered strings in segments (A1, A9).

Rows are range-partitioned and sorted by (group, order) once, so a group that
holds a third of all rows is spread over many partitions.

* ``fold_groups``: each partition folds the batches of a group's rows it holds
  into a state; the states of a group, one per partition at most, are merged in
  the rows' order.
* ``ordered_segments``: a group's strings are joined in order into segments of
  about ``max_chars`` characters; a group that fits is one segment.

Defined results: NULL keys are a group of their own and NULL orders come first;
rows that are equal throughout are rows of their own; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import materialized
from .ranks import range_partitions, running_within

# executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a group that ``step`` gets at once.
BATCH_ROWS = 10_000


def _runs(keys: pa.StructArray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal neighbours."""
    values = keys.to_pylist()
    cuts = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def fold_groups(df: DataFrame, keys: Sequence[str], order: str, start: Callable[[], Any],
                step: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any],
                finish: Callable[[Any], dict], schema: str, parts: int | None = None) -> DataFrame:
    """``keys`` and the columns of ``schema`` (DDL) of each group.

    ``step(state, batch)`` takes the group's rows (all columns of ``df``) in the
    order of ``order``, ``BATCH_ROWS`` at most at once, from ``start()`` on;
    ``merge(earlier, later)`` joins the states of two stretches of rows;
    ``finish(state)`` gives the columns.  States are pickled, so they should
    stay small; ``merge`` must give the same for any cut of the rows."""
    keys = list(keys)
    wanted_type = StructType.fromDDL(schema)
    out_type = to_arrow_type(wanted_type)
    numbered = materialized(df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]).alias("key"),
                                      F.col(order).alias("by"), F.struct(*[df[c] for c in df.columns]).alias("row"))
                            .withColumn("place", F.monotonically_increasing_id()), "folds")
    by = [*[f"key.k{i}" for i in range(len(keys))], "by", "place"]
    rows = numbered.repartitionByRange(parts or range_partitions(df), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, state = None, None, None
        for b in batches:
            wanted, given = b.column(b.schema.get_field_index("key")), b.column(b.schema.get_field_index("row"))
            spot = [b.column(b.schema.get_field_index(c)) for c in ("by", "place")]
            for a, z in _runs(wanted):
                if key is None or not wanted[a].equals(key[0]):
                    if key is not None:
                        yield _state(key, first, state)
                    key, first, state = wanted.slice(a, 1), [c.slice(a, 1) for c in spot], start()
                for at in range(a, z, BATCH_ROWS):
                    state = step(state, pa.RecordBatch.from_struct_array(given.slice(at, min(BATCH_ROWS, z - at))))
        if key is not None:
            yield _state(key, first, state)

    types = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}
    states = rows.select("key", "by", "place", "row").mapInArrow(
        run, f"key {types['key']}, by {types['by']}, place long, state binary")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("stretch", "ascending")])
        whole = None
        for s in table["state"]:
            part = pickle.loads(s.as_py())
            whole = part if whole is None else merge(whole, part)
        return pa.Table.from_pylist([{"key": table["key"][0].as_py(), "out": finish(whole)}],
                                    pa.schema([table.schema.field("key"), pa.field("out", out_type)]))

    # the stretches of a group, numbered in the order of their first rows
    numbered_states = states.withColumn("stretch", F.row_number().over(Window.partitionBy("key").orderBy("by", "place")))
    joined = (numbered_states.select("key", "stretch", "state").groupBy("key")
              .applyInArrow(join, f"key {types['key']}, out {wanted_type.simpleString()}"))
    return joined.select(*[F.col(f"key.k{i}").alias(c) for i, c in enumerate(keys)], "out.*")


def _state(key: pa.StructArray, first: list[pa.Array], state: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *first, pa.array([pickle.dumps(state)], pa.binary())], ["key", "by", "place", "state"])


def ordered_segments(df: DataFrame, keys: Sequence[str], order: str, value: Column, max_chars: int,
                     name: str = "content") -> DataFrame:
    """``keys``, ``segment_no`` and ``name``: the group's values joined
    in the order of ``order`` (unique in a group).  A segment starts at a value
    before which a further ``max_chars`` characters have gone by, so it holds
    ``max_chars`` and one value at most; segments are numbered by those
    characters, from 0, with gaps after a value longer than a segment.  A group
    of at most ``max_chars`` characters is segment 0.  Null values are skipped; a
    group without any other is segment 0 with null."""
    keys = list(keys)
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    rows = df.select(*keys, F.col(order).alias("_os_order"), value.alias("_os_value"))
    rows = rows.withColumn("_os_chars", F.coalesce(F.length("_os_value"), F.lit(0)).cast("long"))
    rows = running_within(rows, "_os_chars", "_os_order", keys, "sum", "_os_before", inclusive=False)
    # the segment of an empty value at a segment's edge is the one before it
    at = F.when(F.col("_os_chars") > 0, F.col("_os_before")).otherwise(F.greatest(F.col("_os_before") - 1, F.lit(0)))
    rows = rows.withColumn("segment_no", F.floor(at / max_chars).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("_os_value").isNotNull(), F.struct("_os_order", "_os_value")))), lambda x: x["_os_value"]), "")
    return (rows.groupBy(*keys, "segment_no")
            .agg(F.when(F.count("_os_value") > 0, joined).alias(name)))
