"""Sinks (S2, S3, S10-S14)."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ranks import rank_within
from .named_files import write_named_json

log = logging.getLogger(__name__)


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet sink."""
    df.write.mode(mode).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str,
                rebuild: bool = False) -> DataFrame:
    """S3: build-or-load.  If ``path`` holds a committed Parquet table (a
    ``_SUCCESS`` marker) and ``rebuild`` is false, read it; otherwise build,
    write and read back.  Downstream work reads the files, so the build's
    lineage is cut and a lost executor never recomputes it."""
    if rebuild or not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_prediction_files(df: DataFrame, path: str, qid: str = "qid", iteration: str = "iteration",
                           checkpoint: str = "checkpoint") -> None:
    """S10/F22 without a Python data source (``write_named_predictions`` writes
    real files): one JSON-array file
    ``qid{q}_iter{i}_checkpoint{n}.json`` for each (qid, iteration, checkpoint),
    its rows sorted.  Spark names part files itself, so each file is a folder of
    that name with one part; ``readers.read_predictions`` goes by the folder.
    A file holds one question's predictions of one iteration, as in the
    reference; null keys make no file."""
    cols = [c for c in df.columns if c not in (iteration, checkpoint)]
    name = tx.prediction_file_name(F.col(qid).cast("long"), F.col(iteration).cast("long"), F.col(checkpoint).cast("long"))
    (df.withColumn("file", name).where(F.col("file").isNotNull())
     .groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
     .select("file", F.to_json("rows", {"ignoreNullFields": "false"}).alias("value"))
     .repartition("file").write.mode("append").partitionBy("file").text(path))


def write_named_predictions(df: DataFrame, path: str, qid: str = "qid", iteration: str = "iteration",
                            checkpoint: str = "checkpoint", null_keys: str = "fail") -> None:
    """S10/F22 under the reference's names: one JSON-array file
    ``qid{q}_iter{i}_checkpoint{n}.json`` for each (qid, iteration, checkpoint),
    its rows sorted, made visible when the whole write has succeeded (see
    ``named_files``).  Rows with a null key raise, or go to the file that
    ``null_keys`` names; a file of its name is replaced."""
    cols = [c for c in df.columns if c not in (iteration, checkpoint)]
    name = tx.prediction_file_name(F.col(qid).cast("long"), F.col(iteration).cast("long"), F.col(checkpoint).cast("long"))
    if null_keys != "fail":
        name = F.coalesce(name, F.lit(null_keys))
    named = df.select(name.alias("_file"), *cols)
    write_named_json(named, path, F.col("_file"), cols, drop=["_file"])


def write_prediction_batches(df: DataFrame, path: str, batch_col: str = "batch_no",
                             checkpoint_col: str = "checkpoint") -> None:
    """Predictions as JSON lines, one folder per (checkpoint, batch) and
    one file per folder (rows are clustered by the folder keys first, so a
    collector stream sees few, whole files); appends never rewrite an
    existing file (new names each job)."""
    (df.repartition(checkpoint_col, batch_col)
     .write.mode("append").partitionBy(checkpoint_col, batch_col).json(path))


def write_wrapped_json(df: DataFrame, path: str, root: str, order: list[str]) -> None:
    """One ``{"<root>": [...]}`` document, rows sorted by ``order``, written
    by all tasks: each row is a line, the first opens the document, the others
    start with a comma, and a line of its own closes it.  The part files in order of their
    names, one after the other, are the document (``hadoop fs -getmerge``), and
    ``readers.read_wrapped_lines`` reads the folder as it is, in parallel."""
    spark = df.sparkSession
    key = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*df.columns)).alias("row"))
    rows = rank_within(df.select(key.alias("k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")), "k", name="n")
    total = rows.select(F.count(F.lit(1))).scalar()
    line = F.concat(F.when(F.col("n") == 0, F.lit(f'{{"{root}": [')).otherwise(F.lit(",")), F.col("row"))
    end = spark.range(1).select(F.when(total == 0, F.lit(f'{{"{root}": [')).alias("open"), total.alias("n"))
    end = end.select(F.explode(F.filter(F.array("open", F.lit("]}")), lambda x: x.isNotNull())).alias("value"), "n")
    (rows.select(line.alias("value"), "n").unionByName(end).orderBy("n", F.desc("value")).select("value")
     .write.mode("overwrite").text(path))


def write_answer_file(df: DataFrame, path: str, file: str, root: str, order: list[str]) -> None:
    """S11 as the one file that a consumer of small results wants:
    ``path/file`` holds ``{"<root>": [...]}``, sorted, streamed by one task.
    ``write_wrapped_json`` writes the same document by all tasks."""
    write_named_json(df, path, F.lit(file), order, root)


def write_sorted_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """S11 scalable form: range-partitioned, sorted JSON lines."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write only when nothing is there yet."""
    df.write.mode("ignore").json(path)


def write_run_config(spark: SparkSession, config: dict, path: str) -> str:
    """One-row JSON config; returns its run id."""
    from ..operators.trials import run_id
    items = sorted((str(k), str(v)) for k, v in config.items())
    df = spark.createDataFrame([(dict(items),)], "config map<string,string>")
    df = df.withColumn("run_id", run_id("config"))
    df.coalesce(1).write.mode("overwrite").json(path)
    return df.select("run_id").first()[0]


def push_batches(push: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Wrap a user push callable for ``foreachBatch``: failures are
    logged and counted, never fatal (best effort, as in the reference)."""
    state = {"failed": 0}

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            push(batch, batch_id)
        except Exception as e:  # noqa: BLE001
            state["failed"] += 1
            log.warning("push of batch %s failed: %s", batch_id, e)
    run.state = state  # type: ignore[attr-defined]
    return run
