"""Streaming arg-min whose state expires.

``best_changes`` keeps the best value of each key in a value state with a time
to live, by ``transformWithStateInPandas``, and puts out a row only when a key's best
gets better.  A key that hasn't got better for ``ttl`` is forgotten; should it
come back, its value is put out again, better or not.  So the state holds the
keys of the last ``ttl`` only, and the rows put out, reduced by ``min``
(``current_best``), are always the batch result: what a forgotten key costs is
a repeated row, never a lost one.

Each access to a state is a round trip between the worker and Spark, so keys are
dealt over ``STATE_BUCKETS`` hash buckets and a bucket's keys are one value: a
batch reads and writes each bucket it touches once, however many keys it has.
Every key keeps the time at which it last got better, and is forgotten by that;
the value itself goes when no key of the bucket got better for ``ttl``.

``transformWithStateInPandas`` needs the RocksDB state store; ``start_best_changes``
sets it, and ends batches without data, for its own query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.readers import read_predictions
from .collect import KEYS, ROCKSDB_PROVIDER

# the processor runs in Python workers; see sources/hooks.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Batches without data go on for ever where state expires by the clock, and a
#: query that drains its source would never end; expired state goes with the
#: next batch that has data.
SETTINGS = {PROVIDER: ROCKSDB_PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: A key is remembered for so long after it last got better.
TTL_SECONDS = 7 * 24 * 3600


#: Buckets of the state; fixed in a query's checkpoint.
STATE_BUCKETS = 2048
_BUCKET, _THERE = "_bucket", "_there"


class BestSoFar(StatefulProcessor):
    """The smallest value of each key of a bucket; a null is worse than any
    value.  The state is a list for each key column, of the values and of the
    times (ms) at which they were put in.  Rows are read in Arrow batches, one
    after the other: a hot key is held nowhere whole."""

    def __init__(self, keys: Sequence[str], metric: str, kinds: Sequence[T.DataType], ttl_ms: int):
        self.keys, self.metric, self.ttl_ms = list(keys), metric, ttl_ms
        self.schema = T.StructType([T.StructField(f"{name}_{i}", T.ArrayType(kind)) for i, (name, kind) in enumerate(
            zip([*self.keys, metric, "at"], [*kinds, T.LongType()], strict=True))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least: dict[tuple, object] = {}
        for some in rows:
            some = some.set_axis([*self.keys, self.metric, _THERE, _BUCKET], axis=1)  # Spark gives derived columns names of its own
            there = some[_THERE].tolist()
            for of, value, valid in zip(zip(*(some[k].tolist() for k in self.keys), strict=True), some[self.metric].tolist(), there, strict=True):
                known = least.setdefault(of, value if valid else None)
                if valid and (known is None or value < known):
                    least[of] = value
        state, now = self.best.get(), timerValues.getCurrentProcessingTimeInMs()
        held = {} if state is None else {tuple(x[:-2]): (x[-2], x[-1]) for x in zip(*state, strict=True) if x[-1] + self.ttl_ms > now}
        better = []
        for of, value in least.items():
            known = held.get(of)
            if known is None or (value is not None and (known[0] is None or value < known[0])):
                held[of] = (value, now)
                better.append(of)
        if better:
            self.best.update(tuple(map(list, zip(*((*of, *x) for of, x in held.items()), strict=True))))
            columns = dict(zip(self.keys, map(list, zip(*better, strict=True)), strict=True))
            yield pd.DataFrame(columns | {self.metric: pd.Series([held[of][0] for of in better], dtype=object)})

    def close(self) -> None:
        pass


def best_changes(stream: DataFrame, keys: Sequence[str] = KEYS, metric: str = "incre_num_by", ttl_seconds: float = TTL_SECONDS,
                 buckets: int = STATE_BUCKETS) -> DataFrame:
    """keys and metric: a row whenever a key's smallest ``metric`` gets smaller
    (or the key is new, or forgotten).  Rows with a null key are left out, as in
    the batch form."""
    rows = stream.dropna(subset=list(keys)).select(*keys, metric)
    kinds = [rows.schema[c].dataType for c in (*keys, metric)]
    # pandas has no nulls among numbers: a null is any value that isn't there
    dealt = rows.select(*keys, F.coalesce(metric, F.lit(0).cast(kinds[-1])).alias(metric), F.col(metric).isNotNull().alias(_THERE),
                        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(_BUCKET))
    return dealt.groupBy(_BUCKET).transformWithStateInPandas(BestSoFar(keys, metric, kinds, int(ttl_seconds * 1000)), rows.schema, "Append", "ProcessingTime")


def current_best(changes: DataFrame, keys: Sequence[str] = KEYS, metric: str = "incre_num_by") -> DataFrame:
    """The best value of each key, from all rows that ``best_changes`` put out."""
    return changes.groupBy(*keys).agg(F.min(metric).alias(metric))


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """A query takes the session's settings when it starts."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start_best_changes(spark: SparkSession, src: str, sink: str, checkpoint_location: str, ttl_seconds: float = TTL_SECONDS,
                       trigger_seconds: int | None = 20, available_now: bool = False, json_lines: bool = False,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """The prediction files that land in ``src``; what gets better
    is appended to the Parquet table ``sink`` (exactly once, also after a
    restart)."""
    preds = read_predictions(spark, src, stream=True, json_lines=json_lines, max_files_per_trigger=max_files_per_trigger)
    q = (best_changes(preds, ttl_seconds=ttl_seconds).writeStream.outputMode("append").format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint_location))
    if available_now:
        q = q.trigger(availableNow=True)
    elif trigger_seconds:
        q = q.trigger(processingTime=f"{trigger_seconds} seconds")
    with _settings(spark):
        return q.start()
