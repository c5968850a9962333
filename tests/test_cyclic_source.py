"""The endless generator as a source: exact over restarts and replays."""

import glob
import os

import pytest

from docloom.sources.cyclic_source import CyclicReader
from docloom.streaming import cyclic


def run(spark, table, tmp, **how):
    s = cyclic.cyclic_stream(spark, table, "id", f"{tmp}/progress.json", **how)
    q = (s.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted((r.generator_step, r.epoch, r.id) for r in spark.read.schema("generator_step long, epoch long, id string").parquet(f"{tmp}/out").collect())


def want(n, upto):
    return [(i, i // n, "abcde"[i % n]) for i in range(upto)]


def test_exactly_the_modulo_sequence_over_restarts(spark, tmp_dir):
    table = spark.createDataFrame([(c,) for c in "ecadb"], "id string")
    for runs in (1, 2):
        assert run(spark, table, tmp_dir, rows_per_batch=7, partitions=3) == want(5, 7 * runs)


def test_a_batch_that_was_planned_but_not_committed_runs_again(spark, tmp_dir):
    table = spark.createDataFrame([(c,) for c in "abc"], "id string")
    run(spark, table, tmp_dir, rows_per_batch=4)
    run(spark, table, tmp_dir, rows_per_batch=4)
    last = max(glob.glob(f"{tmp_dir}/ck/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
    os.remove(last)  # the query stopped between its output and its commit
    got = run(spark, table, tmp_dir, rows_per_batch=4)
    # the batch anew, and a further one if the drain takes it along
    assert len(got) in (8, 12) and got == [(i, i // 3, "abc"[i % 3]) for i in range(len(got))]


def test_an_end_and_an_empty_table(spark, tmp_dir):
    table = spark.createDataFrame([("a",), ("b",)], "id string")
    for _ in range(2):
        got = run(spark, table, tmp_dir, rows_per_batch=4, steps=7)
    assert got == [(i, i // 2, "ab"[i % 2]) for i in range(7)]
    assert run(spark, table.limit(0), tmp_dir + "/none") == []
    assert cyclic.cyclic_batch(table.limit(0), "id", 5).count() == 0


@pytest.mark.parametrize("many", [1, 3, 50])
def test_ranges_and_progress(tmp_dir, many):
    reader = CyclicReader(3, 10, many, None, f"{tmp_dir}/p/progress.json")
    parts = reader.partitions({"step": 5}, {"step": 25})
    rows = [tuple(x.values()) for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert rows == [(i, i % 3, i // 3) for i in range(5, 25)] and len(parts) <= many
    assert reader.partitions({"step": 25}, {"step": 25}) == []
    again = CyclicReader(3, 10, many, None, f"{tmp_dir}/p/progress.json")  # after a restart
    assert again.latestOffset() == {"step": 35} and again.latestOffset() == {"step": 45}
    again.partitions({"step": 0}, {"step": 5})  # a replay doesn't set the note back
    assert CyclicReader(3, 10, many, None, f"{tmp_dir}/p/progress.json").latestOffset() == {"step": 35}
