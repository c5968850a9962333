"""Registered queries: collecting predictions, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect as co
from ..session import fresh_dir
from ..sources import sinks as sk
from ..streaming import collect as sc
from ..streaming import stateful as st
from . import oracle as O
from . import tables as TB
from .registry import ORACLE, register


# ---------------------------------------------------------------- collect

@register("collect_answers", O.with_(O.PREDICTIONS) + """
SELECT checkpoint, CAST(qid AS INTEGER) AS qid, CAST(retrieve AS INTEGER) AS retrieve
FROM (SELECT DISTINCT * FROM preds)
WHERE qid IS NOT NULL AND category IS NOT NULL AND retrieve IS NOT NULL
GROUP BY checkpoint, qid, category, retrieve""")
def collect_answers(spark, d):
    return co.collect_answers(TB.predictions(spark, d), by=["checkpoint"])


@register("prediction_distinct", O.with_(O.PREDICTIONS) + "SELECT DISTINCT * FROM preds")
def prediction_distinct(spark, d):
    return co.distinct_predictions(TB.predictions(spark, d))


@register("best_answer_per_qid", O.with_(O.PREDICTIONS) + """
SELECT checkpoint, CAST(qid AS INTEGER) AS qid,
       CAST(arg_min(retrieve, (incre_num_by, category, retrieve)) AS INTEGER) AS retrieve,
       arg_min(category, (incre_num_by, category, retrieve)) AS category,
       min(incre_num_by) AS incre_num_by
FROM preds WHERE qid IS NOT NULL AND retrieve IS NOT NULL GROUP BY checkpoint, qid""")
def best_answer_per_qid(spark, d):
    return co.best_answer_per_qid(TB.predictions(spark, d), by=["checkpoint"])

# ---------------------------------------------------------------- streaming

COLLECT_SQL = ORACLE["collect_answers"]


@register("stream_collect_answers", COLLECT_SQL)
def stream_collect_answers(spark, d):
    """Predictions written as per-batch files (64 questions
    per batch), drained by a file-source stream with ``availableNow``,
    upserted per micro-batch, answers republished per checkpoint.  (Several micro-batches, a late better value,
    a duplicate file and a restart are covered in tests/test_collect.py.)"""
    preds = TB.predictions(spark, d).withColumn("batch_no", F.floor(F.col("qid") / 64))
    src, sink = fresh_dir(spark, "predictions"), fresh_dir(spark, "collected")
    ckpt, answers = fresh_dir(spark, "stream-state"), fresh_dir(spark, "answers")
    sk.write_prediction_batches(preds, src)
    q = sc.start_collector(spark, src, sink, ckpt, available_now=True, json_lines=True, answers_dir=answers)
    q.awaitTermination()
    # the published answer files (one folder per checkpoint) are the result
    return spark.read.schema("qid int, retrieve int, checkpoint int").json(answers) \
        .select("checkpoint", "qid", "retrieve")


@register("stream_best_changes", O.with_(O.PREDICTIONS) + """
SELECT checkpoint, qid, category, retrieve, min(incre_num_by) AS incre_num_by FROM preds
WHERE checkpoint IS NOT NULL AND qid IS NOT NULL AND category IS NOT NULL AND retrieve IS NOT NULL GROUP BY ALL""")
def stream_best_changes(spark, d):
    """Per-batch prediction files, in several micro-batches, through the
    arg-min whose state expires; what it put out, reduced."""
    preds = TB.predictions(spark, d).withColumn("batch_no", F.floor(F.col("qid") / 64))
    src, sink, ckpt = fresh_dir(spark, "predictions"), fresh_dir(spark, "best-changes"), fresh_dir(spark, "best-state")
    sk.write_prediction_batches(preds, src)
    q = st.start_best_changes(spark, src, sink, ckpt, available_now=True, json_lines=True)
    q.awaitTermination()
    return st.current_best(spark.read.parquet(sink))


@register("stream_dedup_bounded", ORACLE["prediction_distinct"])
def stream_dedup_bounded(spark, d):
    """Streaming distinct of prediction rows with bounded state.  The
    delay is the table's whole time span and a day, so no row is late and no
    key is forgotten however long the table is: the result is the exact
    distinct.  (A live stream states the delay it can promise.)"""
    events = TB.table(spark, d, "events")
    days = events.agg(F.datediff(F.max("ts"), F.min("ts")).alias("n")).first().n or 0
    # a table is a file or a folder of files: the pattern finds either's
    ev = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{d.rstrip('/')}/{{events.parquet,events.parquet/*.parquet}}")
    preds = ev.select(
        "ts", F.col("user_id").alias("qid"), F.col("event_type").alias("category"),
        F.get_json_object("props", "$.k").alias("retrieve"),
        ((F.col("event_id") % 6) * 5).cast("int").alias("incre_num_by"),
        F.element_at(F.array(*[F.lit(c) for c in TB.CHECKPOINTS]), (F.col("event_id") % 3 + 1).cast("int")).alias("checkpoint"))
    cols = ["qid", "category", "retrieve", "incre_num_by", "checkpoint"]
    dedup = sc.dedup_within_watermark(preds, "ts", f"{days + 1} days", cols).select(*cols)
    sink, ckpt = fresh_dir(spark, "dedup"), fresh_dir(spark, "dedup-state")
    q = (dedup.writeStream.outputMode("append").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).format("parquet").option("path", sink).start())
    q.awaitTermination()
    return spark.read.schema(dedup.schema).parquet(sink)
