"""Outbox: retries, dead letters, nothing sent twice, replayed batches."""

import os

from docloom.streaming.outbox import Outbox


def _box(spark, tmp_dir):
    return Outbox(spark, tmp_dir + "/box", "id long, t string")


def test_delivery_over_restarts(spark, tmp_dir):
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(40)], "id long, t string")
    log = tmp_dir + "/sent"
    os.makedirs(log)

    def send(key, row, attempt):
        with open(f"{log}/{key[0]}-{key[1]}-{attempt}", "x") as f:  # a second call for a try fails
            f.write(repr(row))
        if row["id"] == 5 or row["id"] == 6 and attempt < 3:
            raise ValueError("no")

    box = _box(spark, tmp_dir)
    box.deliver(send)  # nothing there yet
    box.put(rows.where("id < 20"), 0, "id")
    box.put(rows.where("id < 20"), 0, "id")  # a replayed batch
    box.deliver(send)
    box = _box(spark, tmp_dir)  # a restart
    box.put(rows.where("id >= 20"), 1, "id")
    box.put(rows.where("id < 0"), 2, "id")
    assert box.pending().count() == 20
    box.deliver(send)
    box.deliver(send)
    got = box.receipts().collect()
    assert len(got) == len({(r.batch_id, r.row_id) for r in got}) == 40
    assert {(r.status, r.tries) for r in got if (r.batch_id, r.row_id) == (0, 6)} == {("sent", 3)}
    dead = box.dead_letters().collect()
    assert [(r.row.id, r.tries, r.error) for r in dead] == [(5, 3, "ValueError: no")]
    assert len(os.listdir(log)) == 38 + 3 + 3
    assert box.pending().count() == 0


def test_as_a_stream_sink(spark, tmp_dir):
    rows = spark.createDataFrame([(i, str(i)) for i in range(10)], "id long, t string")
    rows.write.parquet(tmp_dir + "/in")
    box = _box(spark, tmp_dir)
    for _ in range(2):
        (spark.readStream.schema(rows.schema).parquet(tmp_dir + "/in").writeStream.foreachBatch(box.sink("id"))
         .option("checkpointLocation", tmp_dir + "/ckpt").trigger(availableNow=True).start().awaitTermination())
    box.deliver(lambda key, row, attempt: None)
    assert sorted(r.row.id for r in box.rows().collect()) == list(range(10)) and box.receipts().count() == 10
