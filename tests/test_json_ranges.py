"""Large JSON documents by byte ranges: the same rows as a multi-line read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.sources import json_ranges as jr
from docloom.sources import readers as rd

NASTY = ['}', ']}', '"', '\\', '\\"', '{"a": [', '","', "]", "\n", "é中😀", "\\\\", "},{", "plain words", "", "\\u007d", "/", "\t"]


@pytest.fixture(params=[97, 1500])
def small_ranges(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def some_question(draw, i):
    return {"qid": i, "source": [draw.randint(0, 99) for _ in range(draw.randint(0, 4))], "query": "".join(draw.choices(NASTY, k=draw.randint(0, 6))),
            "category": draw.choice(["faq", "}", None]), "extra": {"deep": [{"x": "}]"}, []]}}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("indent", [None, 2])
def test_wrapped_documents(spark, tmp_dir, small_ranges, indent):
    draw = random.Random(4)
    for n in (0, 1, 12):
        with open(f"{tmp_dir}/doc{n}.json", "w", encoding="utf-8") as f:
            json.dump({"before": [{"qid": -1}, "]"], "meta": {"questions": [{"qid": -2}]}, "questions": [some_question(draw, i) for i in range(n)],
                       "after": [{"qid": -3}], "n": 3}, f, ensure_ascii=n == 1, indent=indent)
            f.write("\n" * (n % 2))
    got = jr.read_json_document(spark, tmp_dir, "questions", S.QUESTION)
    assert rows(got) == rows(rd.read_wrapped_json(spark, tmp_dir, "questions", S.QUESTION)) and got.count() == 13
    if small_ranges > 97:
        assert rows(rd.read_questions(spark, tmp_dir, parallel=True)) == rows(got)
    pieces = jr._fragments(spark, f"{tmp_dir}/doc12.json", "}").select(F.countDistinct("start")).first()[0]
    assert pieces > 1 or small_ranges > 97


def test_id_maps(spark, tmp_dir, small_ranges):
    draw = random.Random(8)
    for n in (0, 1, 12):
        doc = {str(100 * n + i): None if i == 7 else [{"question": draw.choice(NASTY), "answers": draw.choices(NASTY, k=draw.randint(0, 3))}
                                                     for _ in range(draw.randint(0, 4))] for i in range(n)}
        with open(f"{tmp_dir}/map{n}.json", "w", encoding="utf-8") as f:
            json.dump(doc, f, ensure_ascii=False)
    assert rows(jr.read_id_map(spark, tmp_dir)) == rows(rd.read_faq_map(spark, tmp_dir))
    if small_ranges > 97:
        assert rd.read_faq_map(spark, tmp_dir, parallel=True).count() == rd.read_faq_map(spark, tmp_dir).count()


def test_a_record_larger_than_many_ranges(spark, tmp_dir, small_ranges):
    long = "}{][" * 250
    with open(f"{tmp_dir}/one.json", "w") as f:
        json.dump({"questions": [{"qid": 1, "query": long}, {"qid": 2, "query": "x"}, None, {"qid": 3, "query": long}]}, f)
    got = jr.read_json_document(spark, tmp_dir, "questions", S.QUESTION).orderBy("qid").collect()
    assert [(r.qid, r["query"]) for r in got] == [(1, long), (2, "x"), (3, long)]


@pytest.mark.parametrize("text", ['{"questions": [{"qid": 1}', '{"questions": [{"qid": 1}]', '{"questions": [{"qid": "1}]}', '{"questions": [{"qid": 1}]}}'])
def test_a_broken_document_raises(spark, tmp_dir, text):
    with open(f"{tmp_dir}/broken.json", "w") as f:
        f.write(text)
    with pytest.raises(Exception, match="ends inside"):
        jr.read_json_document(spark, tmp_dir, "questions", S.QUESTION).collect()


def test_records_that_end_in_arrays_in_wrapped_lines(spark, tmp_dir):
    from docloom.sources import sinks as sk
    turns = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, []), (4, None), (5, [4])], "qid long, source array<long>")
    sk.write_wrapped_json(turns, tmp_dir + "/w", "questions", ["qid"])
    back = rd.read_wrapped_lines(spark, tmp_dir + "/w", "questions", turns.schema)
    assert rows(back) == rows(turns)
    sk.write_wrapped_json(turns.limit(0), tmp_dir + "/none", "questions", ["qid"])
    assert rd.read_wrapped_lines(spark, tmp_dir + "/none", "questions", turns.schema).count() == 0
