"""Files under names of their own: whole or not at all, once."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.sources import readers as rd
from docloom.sources import sinks as sk
from docloom.sources.named_files import NamedFilesWriter, write_named_json

SCHEMA = "qid long, iteration long, checkpoint long, category string, retrieve string, incre_num_by int"


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("_staging") and f != "_SUCCESS")


def preds(spark, n=200):
    return spark.createDataFrame([(i % 7, i % 2, 120, "faq", f"é{i}", i) for i in range(n)], SCHEMA).repartition(5)


def test_real_files_under_their_names(spark, tmp_dir):
    sk.write_named_predictions(preds(spark), tmp_dir)
    assert files(tmp_dir) == [f"qid{q}_iter{i}_checkpoint120.json" for q in range(7) for i in range(2)]
    assert all(os.path.isfile(f"{tmp_dir}/{f}") for f in files(tmp_dir))
    with open(f"{tmp_dir}/qid3_iter1_checkpoint120.json", encoding="utf-8") as f:
        got = json.load(f)
    assert got == sorted(({"qid": 3, "category": "faq", "retrieve": f"é{i}", "incre_num_by": i} for i in range(200) if i % 7 == 3 and i % 2 == 1), key=lambda r: r["retrieve"])
    assert rd.read_predictions(spark, tmp_dir).count() == 200


def test_written_again_is_replaced_and_the_same(spark, tmp_dir):
    read = lambda: {f: open(f"{tmp_dir}/{f}", encoding="utf-8").read() for f in files(tmp_dir)}
    sk.write_named_predictions(preds(spark), tmp_dir)
    before = read()
    sk.write_named_predictions(preds(spark).repartition(2), tmp_dir)
    assert read() == before and rd.read_predictions(spark, tmp_dir).count() == 200


def test_a_failed_write_leaves_no_file(spark, tmp_dir):
    bad = preds(spark).withColumn("retrieve", F.when(F.col("incre_num_by") == 150, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("retrieve")))
    with pytest.raises(Exception, match="broken row"):
        sk.write_named_predictions(bad, tmp_dir)
    assert files(tmp_dir) == [] and not os.path.exists(f"{tmp_dir}/_staging") or os.listdir(f"{tmp_dir}/_staging") == []


def test_of_several_attempts_one_file_remains(tmp_dir):
    writer = NamedFilesWriter(tmp_dir, "[", ",\n", "]", False)
    rows = [pa.record_batch([pa.array(["a.json", "a.json", "b.json"]), pa.array(["1", "2", "3"])], ["file", "value"]),
            pa.record_batch([pa.array(["b.json"]), pa.array(["4"])], ["file", "value"])]

    def failing():
        yield rows[0]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    writer.write(iter(rows))  # a speculative attempt that isn't the one committed
    assert files(tmp_dir) == []
    writer.commit([writer.write(iter(rows)), None])
    assert files(tmp_dir) == ["a.json", "b.json"] and os.listdir(f"{tmp_dir}/_staging") == []
    assert open(f"{tmp_dir}/a.json").read() == "[1,\n2]" and open(f"{tmp_dir}/b.json").read() == "[3,\n4]"


def test_rows_of_a_file_in_two_places_raise(tmp_dir):
    writer = NamedFilesWriter(tmp_dir, "", "\n", "\n", False)
    batch = pa.record_batch([pa.array(["a", "b", "a"]), pa.array(["1", "2", "3"])], ["file", "value"])
    with pytest.raises(ValueError, match="two places"):
        writer.write(iter([batch]))
    one = pa.record_batch([pa.array(["a"]), pa.array(["1"])], ["file", "value"])
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([writer.write(iter([one])), writer.write(iter([one]))])
    assert files(tmp_dir) == []


def test_null_keys(spark, tmp_dir):
    some = spark.createDataFrame([(1, 0, 120, "faq", "1", 0), (None, 0, 120, "faq", "2", 0), (2, None, 120, "faq", "3", 0)], SCHEMA)
    with pytest.raises(Exception, match="no file name"):
        sk.write_named_predictions(some, tmp_dir)
    assert files(tmp_dir) == []
    sk.write_named_predictions(some, tmp_dir, null_keys="rest.json")
    assert files(tmp_dir) == ["qid1_iter0_checkpoint120.json", "rest.json"]
    with open(f"{tmp_dir}/rest.json") as f:
        assert sorted(r["retrieve"] for r in json.load(f)) == ["2", "3"]


def test_overwrite_and_no_rows(spark, tmp_dir):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    write_named_json(df, tmp_dir, F.concat(F.col("v"), F.lit(".json")), ["k"])
    write_named_json(df.where("k = 1"), tmp_dir, F.lit("z.json"), ["k"], root="answers", mode="overwrite")
    assert files(tmp_dir) == ["z.json"] and json.load(open(f"{tmp_dir}/z.json")) == {"answers": [{"k": 1, "v": "x"}]}
    write_named_json(df.limit(0), tmp_dir, F.lit("none.json"), ["k"])
    assert files(tmp_dir) == ["z.json"]
