"""Endless cyclic row source.

The reference's generator yields ``rows[i % n]`` forever.  As a stream: a
``rate`` source supplies ``value = 0, 1, 2, …``; a stream-static equi-join on
``value % n = row_no`` picks the row.  The static side is the numbered table
(``splits.row_positions``); Spark plans the join as it would any stream-static
join (broadcast only when the static side is small enough).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import row_positions
from ..sources.cyclic_source import CyclicSteps


def cyclic_rows(spark: SparkSession, table: DataFrame, order: str, rows_per_second: int = 100,
                id_col: str = "generator_step") -> DataFrame:
    """A stream that replays ``table`` in ``order`` endlessly; each output row
    carries its global step ``generator_step`` and ``epoch``."""
    numbered = row_positions(table, order, name="_cy_row")
    n = table.count()
    if n == 0:
        raise ValueError("cannot cycle an empty table")
    ticks = (spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
             .select(F.col("value").alias(id_col), (F.col("value") % n).alias("_cy_row"),
                     F.floor(F.col("value") / n).alias("epoch")))
    return ticks.join(numbered, ["_cy_row"], "inner").drop("_cy_row")


def cyclic_batch(table: DataFrame, order: str, steps: int) -> DataFrame:
    """Batch form: the first ``steps`` rows of the endless sequence."""
    from ..operators.splits import epoch_replay
    n = table.count()
    epochs = -(-steps // n) if n else 1  # an empty table replays to nothing
    return epoch_replay(table, order, epochs).where(F.col("step") < steps)


def cyclic_stream(spark: SparkSession, table: DataFrame, order: str, progress: str, rows_per_batch: int = 1000,
                  partitions: int = 8, steps: int | None = None, id_col: str = "generator_step") -> DataFrame:
    """The same endless sequence, replayable: a source of steps with
    offsets (see ``sources.cyclic_source``) instead of a clock, joined with the
    numbered table.  A restarted query goes on with the next step, whatever its
    batches were; ``progress`` is a file beside its checkpoint, one for each
    query.  The table must stay the same.  An empty table gives no rows."""
    spark.dataSource.register(CyclicSteps)
    numbered = row_positions(table, order, name="_cy_row")
    source = (spark.readStream.format("cyclic_steps").option("rows", table.count()).option("rowsPerBatch", rows_per_batch)
              .option("partitions", partitions).option("progress", progress))
    if steps is not None:
        source = source.option("steps", steps)
    ticks = source.load().select(F.col("step").alias(id_col), F.col("row_no").alias("_cy_row"), "epoch")
    return ticks.join(numbered, ["_cy_row"], "inner").drop("_cy_row")
