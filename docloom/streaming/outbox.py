"""Outbox delivery (S12, T5): rows are kept until they are sent, each tried
several times, and those that can't be sent are kept as dead letters.

``path/rows/batch_id=<n>`` holds a batch's rows, numbered; a batch that is put
again replaces itself, so a replayed batch of a stream adds nothing.
``path/receipts/run=<n>`` holds one receipt a row of a finished run.  A run sends
the rows without a receipt, a few at a time inside the tasks, and its receipts
become visible when all of it has ended: nothing with a receipt is sent again.
Where a task dies on the way its rows are sent again by the next attempt, so the
callable gets a key (batch_id, row_id) by which a receiver tells repeats.

Defined results: an empty batch is a batch of no rows; null values are sent as
nulls; a callable that raises anything is a failed try of that row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import rank_within

RECEIPT = "batch_id long, row_id long, status string, tries int, error string"

#: send((batch_id, row_id), row as a dict, number of the try from 1)
Send = Callable[[tuple[int, int], dict, int], None]


class Outbox:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _read(self, sub: str, schema: str) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        if not p.getFileSystem(conf).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{sub}")

    def put(self, rows: DataFrame, batch_id: int, order: str) -> None:
        """Keep a batch, its rows numbered by ``order``."""
        numbered = rank_within(rows, order, name="row_id").select("row_id", F.struct(*rows.columns).alias("row"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={int(batch_id)}")

    def sink(self, order: str) -> Callable[[DataFrame, int], None]:
        """``put`` for ``foreachBatch``."""
        return lambda rows, batch_id: self.put(rows, batch_id, order)

    def rows(self) -> DataFrame:
        return self._read("rows", f"row_id long, row struct<{self.schema}>, batch_id long")

    def receipts(self) -> DataFrame:
        return self._read("receipts", RECEIPT + ", run string").drop("run")

    def pending(self) -> DataFrame:
        return self.rows().join(self.receipts(), ["batch_id", "row_id"], "left_anti")

    def dead_letters(self) -> DataFrame:
        """Rows that were tried as often as allowed, with the last error."""
        dead = self.receipts().where(F.col("status") == "dead").select("batch_id", "row_id", "tries", "error")
        return self.rows().join(dead, ["batch_id", "row_id"])

    def deliver(self, send: Send, tries: int = 3) -> None:
        """Send what is pending, by all tasks; each row up to ``tries`` times."""
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in frames:
                out = []
                for r in b.to_pylist():
                    done, error, at = "dead", None, 0
                    for at in range(1, tries + 1):
                        try:
                            send((r["batch_id"], r["row_id"]), r["row"], at)
                            done, error = "sent", None
                            break
                        except Exception as e:  # noqa: BLE001
                            error = f"{type(e).__name__}: {e}"
                    out.append({"batch_id": r["batch_id"], "row_id": r["row_id"], "status": done, "tries": at, "error": error})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("batch_id", pa.int64()), ("row_id", pa.int64()), ("status", pa.string()),
                                                                  ("tries", pa.int32()), ("error", pa.string())]))

        todo = self.pending().select("batch_id", "row_id", "row")
        todo.mapInArrow(run, RECEIPT).write.parquet(f"{self.path}/receipts/run={uuid.uuid4().hex}")
