"""Streaming arg-min with expiring state: always the batch result."""

import json
import os
import time

from docloom.operators import collect as co
from docloom.sources import readers as rd
from docloom.streaming import stateful as st
from docloom.streaming.collect import KEYS


def put(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        json.dump([dict(zip(("qid", "category", "retrieve", "incre_num_by"), r, strict=True)) for r in rows], f)
    os.replace(f"{path}/.{name}", f"{path}/{name}")


def drain(spark, tmp, **how):
    q = st.start_best_changes(spark, f"{tmp}/src", f"{tmp}/sink", f"{tmp}/ck", available_now=True, max_files_per_trigger=1, **how)
    q.awaitTermination()
    return q.recentProgress


def result(spark, tmp):
    changes = spark.read.parquet(f"{tmp}/sink")
    return sorted(map(tuple, st.current_best(changes).select(*KEYS, "incre_num_by").collect())), changes.count()


def batch(spark, tmp):
    return sorted(map(tuple, co.best_predictions(rd.read_predictions(spark, f"{tmp}/src"), by=["checkpoint"]).select(*KEYS, "incre_num_by").collect()))


def test_several_batches_a_restart_and_a_late_better_value(spark, tmp_dir):
    put(f"{tmp_dir}/src", "qid0_iter0_checkpoint120.json", [(1, "faq", "7", 10), (1, "faq", "7", 10), (2, "faq", "3", 5), (None, "faq", "3", 5), (3, "faq", "9", None)])
    put(f"{tmp_dir}/src", "qid0_iter1_checkpoint120.json", [(1, "faq", "7", 10), (2, "faq", "3", 15), (3, "faq", "9", 20)])
    drain(spark, tmp_dir)
    assert result(spark, tmp_dir)[0] == batch(spark, tmp_dir)
    assert result(spark, tmp_dir)[1] == 4  # 1, 2, 3 without a value, 3 with one: nothing that isn't better
    put(f"{tmp_dir}/src", "qid9_iter2_checkpoint120.json", [(1, "faq", "7", 0), (2, "faq", "3", 5)])
    put(f"{tmp_dir}/src", "qid9_iter2_checkpoint480.json", [(1, "faq", "7", 30)])
    drain(spark, tmp_dir)
    assert result(spark, tmp_dir) == (batch(spark, tmp_dir), 6)


def test_forgotten_keys_cost_a_row_and_no_result(spark, tmp_dir):
    for i in range(6):
        put(f"{tmp_dir}/src", f"qid{i}_iter0_checkpoint120.json", [(100 * i + k, "faq", "7", 5) for k in range(100)] + [(-1, "faq", "1", 10 - i)])
        time.sleep(0.7)
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in drain(spark, tmp_dir, ttl_seconds=0.5) if p["stateOperators"]]
        # only keys of the last half second: a hundred or two of the 601
        assert rows and max(rows) <= 250, rows
    put(f"{tmp_dir}/src", "qid99_iter0_checkpoint120.json", [(3, "faq", "7", 50), (4, "faq", "7", 0)])
    drain(spark, tmp_dir, ttl_seconds=0.5)
    got, n = result(spark, tmp_dir)
    assert got == batch(spark, tmp_dir) and n >= 602


def test_the_sessions_provider_comes_back(spark, tmp_dir):
    before = spark.conf.get(st.PROVIDER, None)
    put(f"{tmp_dir}/src", "qid0_iter0_checkpoint120.json", [(1, "faq", "7", 10)])
    drain(spark, tmp_dir)
    assert spark.conf.get(st.PROVIDER, None) == before


def test_state_is_read_once_for_each_bucket_and_not_for_each_key(spark, tmp_dir):
    rows = [(k % 50, "faq", str(k), 5 * (k % 3)) for k in range(4000)]
    put(f"{tmp_dir}/src", "qid0_iter0_checkpoint120.json", rows)
    preds = rd.read_predictions(spark, f"{tmp_dir}/src", stream=True)
    with st._settings(spark):
        q = (st.best_changes(preds, buckets=16).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_dir}/sink")
             .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert result(spark, tmp_dir) == (batch(spark, tmp_dir), 4000)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 16
