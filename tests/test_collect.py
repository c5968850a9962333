"""Collecting predictions: batch golden case, stream = batch, restart."""

import json
import os

from pyspark.sql import functions as F

from docloom.operators import collect as co
from docloom.sources import readers as rd
from docloom.streaming import collect as sc


def test_collect_golden(spark):
    df = spark.createDataFrame([(3, "faq", "7", 5), (3, "faq", "7", 0), (3, "faq", "8", 10), (3, "faq", "8", 10)],
                               "qid long, category string, retrieve string, incre_num_by int")
    got = sorted((r.qid, r.retrieve) for r in co.collect_answers(df).collect())
    assert got == [(3, 7), (3, 8)]
    best = co.best_answer_per_qid(df).first()
    assert (best.qid, best.retrieve, best.incre_num_by) == (3, 7, 0)
    assert co.distinct_predictions(df).count() == 3


def _write(path, name, rows):
    tmp = os.path.join(path, "." + name + ".tmp")
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=4)
    os.replace(tmp, os.path.join(path, name))  # atomic: the stream never sees half a file


def test_reader_file_names(spark, tmp_dir):
    _write(tmp_dir, "qid1_iter0_checkpoint120.json", [{"qid": 1, "category": "faq", "retrieve": "7", "incre_num_by": 5}])
    _write(tmp_dir, "qid2_iter1_checkpoint480.json", [{"qid": 2, "category": "faq", "retrieve": "8", "incre_num_by": 0}])
    _write(tmp_dir, "pred_retrieve_120.json", [{"qid": 9, "category": "faq", "retrieve": "9", "incre_num_by": 0}])
    _write(tmp_dir, "qid3_iter0_checkpoint120.json", [])
    got = sorted((r.qid, r.checkpoint) for r in rd.read_predictions(spark, tmp_dir).collect())
    assert got == [(1, 120), (2, 480)]
    assert rd.read_predictions(spark, tmp_dir, checkpoint=480).count() == 1


def test_stream_equals_batch_and_restart(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    os.makedirs(src)
    batches = [
        [{"qid": 1, "category": "faq", "retrieve": "7", "incre_num_by": 10}],
        [{"qid": 1, "category": "faq", "retrieve": "7", "incre_num_by": 10},   # duplicate file content
         {"qid": 2, "category": "finance", "retrieve": "3", "incre_num_by": 5}],
        [{"qid": 1, "category": "faq", "retrieve": "7", "incre_num_by": 0}],    # better value arrives late
    ]
    for i, rows in enumerate(batches[:2]):
        _write(src, f"qid{i}_iter{i}_checkpoint120.json", rows)
    ans = os.path.join(tmp_dir, "answers")

    def drain():
        sc.start_collector(spark, src, sink, ck, available_now=True, max_files_per_trigger=1, answers_dir=ans).awaitTermination()
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(ans) for f in fs if f.startswith("part-")}
    before = drain()
    _write(src, "qid9_iter2_checkpoint120.json", batches[2])
    after = drain()  # a restart; this batch touches question 1 alone
    published = sorted((r.checkpoint, r.qid, r.retrieve) for r in spark.read.json(ans).collect())
    assert published == [(120, 1, 7), (120, 2, 3)]
    assert len(before) == len(after) == 2 and len(before.items() & after.items()) == 1
    short = os.path.join(tmp_dir, "short")
    sc.compact_collected(spark, sink, short)
    assert sorted(sc.read_collected(spark, short).collect()) == sorted(sc.read_collected(spark, sink).collect())
    assert spark.read.parquet(short).count() == 2
    got = sorted((r.checkpoint, r.qid, r.category, r.retrieve, r.incre_num_by)
                 for r in sc.read_collected(spark, sink).collect())
    assert got == [(120, 1, "faq", "7", 0), (120, 2, "finance", "3", 5)]
    batch = co.best_predictions(rd.read_predictions(spark, src), by=["checkpoint"])
    assert sorted(tuple(r) for r in batch.select("checkpoint", "qid", "category", "retrieve", "incre_num_by").collect()) == got


def test_dedup_within_watermark(spark, tmp_dir):
    rows = [(f"2024-01-0{d} 00:00:00", 1, "a") for d in (1, 2, 3)] + [("2024-01-04 00:00:00", 2, "a")]
    df = spark.createDataFrame(rows, "ts string, k long, v string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(os.path.join(tmp_dir, "in"))
    s = spark.readStream.schema(df.schema).parquet(os.path.join(tmp_dir, "in"))
    out = sc.dedup_within_watermark(s, "ts", "30 days", ["k", "v"]).select("k", "v")
    q = (out.writeStream.format("parquet").option("path", os.path.join(tmp_dir, "out"))
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()) == [(1, "a"), (2, "a")]


def test_push_batches_swallows(spark):
    from docloom.sources.sinks import push_batches

    def bad(df, i):
        raise RuntimeError("down")
    run = push_batches(bad)
    run(spark.range(1), 0)
    assert run.state["failed"] == 1


def test_collector_rocksdb_state(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    os.makedirs(src)
    _write(src, "qid1_iter0_checkpoint600.json", [{"qid": 5, "category": "faq", "retrieve": "2", "incre_num_by": 15},
                                                 {"qid": 5, "category": "faq", "retrieve": "2", "incre_num_by": 5}])
    prev = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", sc.ROCKSDB_PROVIDER)
        q = sc.start_collector(spark, src, sink, ck, available_now=True)
        q.awaitTermination()
    finally:
        if prev:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", prev)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in sc.read_collected(spark, sink).collect()]
    assert got == [(600, 5, "faq", "2", 5)]
