"""Sources and sinks: round trips on temp folders."""

import json
import os

import pytest

from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.sources import hooks as hk
from docloom.sources import readers as rd
from docloom.sources import sinks as sk
from docloom.streaming import cyclic


def test_wrapped_json_and_faq_map(spark, tmp_dir):
    qf = os.path.join(tmp_dir, "q.json")
    with open(qf, "w", encoding="utf-8") as f:
        json.dump({"questions": [{"qid": 1, "source": [3, 1], "query": "「a」", "category": "faq"},
                                 {"qid": 2, "source": [], "query": "b", "category": "finance"}]}, f, ensure_ascii=False)
    q = rd.read_questions(spark, qf).orderBy("qid").collect()
    assert [(r.qid, r.source, r.query) for r in q] == [(1, [3, 1], "「a」"), (2, [], "b")]
    ff = os.path.join(tmp_dir, "faq.json")
    with open(ff, "w", encoding="utf-8") as f:
        json.dump({"7": [{"question": "q1", "answers": ["a", "b"]}, {"question": "q2", "answers": ["c"]}]}, f)
    rows = rd.read_faq_map(spark, ff).orderBy("rec").collect()
    assert [(r.faqid, r.rec, r.question, r.answers) for r in rows] == [(7, 0, "q1", ["a", "b"]), (7, 1, "q2", ["c"])]


def test_materialize_and_write_once(spark, tmp_dir):
    p = os.path.join(tmp_dir, "corpus")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("f_1.pdf", "f", "x", 1, 1)], S.CORPUS)
    sk.materialize(spark, build, p)
    sk.materialize(spark, build, p)
    assert len(calls) == 1 and rd.read_corpus(spark, p).count() == 1
    m = os.path.join(tmp_dir, "metrics")
    sk.write_once(spark.createDataFrame([(1.0,)], "precision double"), m)
    sk.write_once(spark.createDataFrame([(2.0,)], "precision double"), m)
    assert spark.read.json(m).first()[0] == 1.0


def test_wrapped_answers_and_run_config(spark, tmp_dir):
    df = spark.createDataFrame([(2, 5), (1, 9)], "qid int, retrieve int")
    out = os.path.join(tmp_dir, "answers")
    sk.write_wrapped_json(df, out, "answers", ["qid"])
    def document(path):
        parts = sorted(x for x in os.listdir(path) if x.startswith("part-"))
        return json.loads("".join(open(os.path.join(path, x)).read() for x in parts))
    assert document(out) == {"answers": [{"qid": 1, "retrieve": 9}, {"qid": 2, "retrieve": 5}]}
    assert sorted(tuple(r) for r in rd.read_wrapped_lines(spark, out, "answers", df.schema).collect()) == [(1, 9), (2, 5)]
    many = spark.range(500).selectExpr("cast(500 - id as int) AS qid", "cast(id as int) AS retrieve").repartition(7)
    sk.write_wrapped_json(many, out, "answers", ["qid"])
    assert [x["qid"] for x in document(out)["answers"]] == list(range(1, 501))
    sk.write_wrapped_json(many.where("false"), out, "answers", ["qid"])
    assert document(out) == {"answers": []} and rd.read_wrapped_lines(spark, out, "answers", df.schema).count() == 0
    rid = sk.write_run_config(spark, {"lr": 0.1, "bs": 2}, os.path.join(tmp_dir, "cfg"))
    assert len(rid) == 64


def test_text_fallback_and_binary(spark, tmp_dir):
    for name, txt in (("finance_1.txt", "hello"), ("finance_2.txt", "world")):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(txt)
    with open(os.path.join(tmp_dir, "finance_3.pdf"), "wb") as f:
        f.write(b"<html><body><p>Hi <b>there</b></p><script>x</script></body></html>")
    fb = {r.stem: r.text for r in rd.read_text_fallback(spark, tmp_dir).collect()}
    assert fb == {"finance_1": "hello", "finance_2": "world"}
    b = rd.file_name_parts(rd.read_binary(spark, tmp_dir))
    out = hk.documents_to_text(b, keep=("filename", "category", "doc_num")).first()
    assert (out.filename, out.category, out.doc_num, out.text, out.error) == ("finance_3.pdf", "finance", 3, "Hi there", None)


def test_parser_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "id long, content string")

    def parser(v):
        if v == "boom":
            raise ValueError("bad pdf")
        return v.upper()
    got = {r.id: (r.text, r.error) for r in hk.documents_to_text(df, parser=parser, keep=("id",)).collect()}
    assert got[1] == ("OK", None) and got[2][0] is None and "bad pdf" in got[2][1]


def test_charset_cases(spark):
    big5 = "財務報告書說明公司資產與負債的情況"
    cases = [(big5.encode("big5"), big5, "big5", True), ("这是简体中文的说明书".encode("gb18030"), "这是简体中文的说明书", "gb18030", True),
             ("plain".encode("utf-16"), "plain", "utf-16", True), ("plain".encode("utf-16-le"), None, None, False),
             ("\ufeffmark".encode(), "mark", "utf-8-sig", True), ("naïve café".encode("cp1252"), "naïve café", "cp1252", True),
             (b"\xff\xfe\x00", None, None, False), (b"\x81\x00", None, None, False), (None, None, None, False), (b"", "", "utf-8", True)]
    cases += [(w.encode("big5"), w, "big5", True) for w in ("保險", "金融", "問題", "答案", "資料", "公司", "股票", "銀行")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id long, content binary")
    got = {r.id: (r.text, r.encoding, r.ok) for r in hk.normalize_charset(df, keep=("id",)).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_charset(spark):
    df = spark.createDataFrame([(1, "café".encode("utf-8")), (2, "café".encode("latin-1"))], "id long, content binary")
    got = {r.id: (r.text, r.encoding, r.ok) for r in hk.normalize_charset(df, keep=("id",), candidates=("cp1252",)).collect()}
    assert got == {1: ("café", "utf-8", True), 2: ("café", "cp1252", True)}


def test_transform_nodes(spark):
    nodes = spark.createDataFrame([(1, "group", "中 文"), (1, "text", "中 文"), (1, "text", None)],
                                  "doc_id long, kind string, text string")
    out = [r.text for r in hk.transform_nodes(nodes, lambda c: F.upper(F.regexp_replace(c, " ", ""))).collect()]
    assert out == ["中 文", "中文", None]
    py = [r.text for r in hk.transform_nodes(nodes, lambda s: s.replace(" ", ""), is_column_fn=False).collect()]
    assert py == ["中 文", "中文", None]


def test_score_batches(spark):
    def echo_model():
        """Stands for a user's model: the ids as start logits, negated as end logits."""
        def predict(ids):
            import numpy as np
            x = np.asarray(ids, dtype=np.float32)
            return {"start_logits": x, "end_logits": -x}
        return predict
    df = spark.createDataFrame([([1, 2, 3, 4],), ([5, 6],)], "input_ids array<int>")
    out = sorted(r.start_logits for r in hk.score_batches(df, echo_model, seq_len=4).collect())
    assert out == [[1, 2, 3, 4], [5, 6, 0, 0]]
    with pytest.raises(Exception, match="longer than seq_len"):
        hk.score_batches(df, echo_model, seq_len=3).collect()


def test_tree_walk_and_pictures(spark):
    nodes = spark.createDataFrame([(1, 1, None, "group", "a b"), (1, 2, 1, "picture", "c d"), (1, 3, 2, "group", "e f"), (1, 4, 3, "text", "g h"),
                                   (1, 5, 1, "text", "i j"), (2, 1, None, "text", "k l"), (2, 9, 8, "text", "lost")],
                                  "doc_id long, node_id long, parent_id long, kind string, text string")
    walked = hk.walk_tree(nodes)
    assert sorted((r.doc_id, r.node_id, r.level, r.under_picture) for r in walked.where("level IS NOT NULL").collect()) == [
        (1, 1, 0, False), (1, 2, 1, False), (1, 3, 2, True), (1, 4, 3, True), (1, 5, 1, False), (2, 1, 0, False)]
    assert walked.count() == 7
    out = hk.transform_nodes(walked, lambda c: F.replace(c, F.lit(" "), F.lit("")), traverse_pictures=False)
    assert {r.text for r in out.collect()} == {"a b", "cd", "e f", "g h", "ij", "kl", "lost"}
    with pytest.raises(ValueError):
        hk.transform_nodes(nodes, F.upper, traverse_pictures=False)


def test_named_prediction_files(spark, tmp_dir):
    df = spark.createDataFrame([(1, "faq", "7", 0, 0, 120), (1, "faq", "8", 5, 0, 120), (2, "finance", None, 5, 1, 480)],
                               "qid long, category string, retrieve string, incre_num_by int, iteration int, checkpoint int")
    sk.write_prediction_files(df, tmp_dir + "/p")
    assert sorted(x for x in os.listdir(tmp_dir + "/p") if x.startswith("file=")) == [
        "file=qid1_iter0_checkpoint120.json", "file=qid2_iter1_checkpoint480.json"]
    got = sorted((r.qid, r.retrieve or "", r.checkpoint) for r in rd.read_predictions(spark, tmp_dir + "/p").collect())
    assert got == [(1, "7", 120), (1, "8", 120), (2, "", 480)]


def test_cyclic_batch(spark):
    df = spark.createDataFrame([(i,) for i in (10, 20, 30)], "id long")
    got = [r.id for r in cyclic.cyclic_batch(df, "id", 7).orderBy("step").collect()]
    assert got == [10, 20, 30, 10, 20, 30, 10]


def test_cyclic_stream(spark, tmp_dir):
    df = spark.createDataFrame([(i,) for i in (10, 20, 30)], "id long")
    s = cyclic.cyclic_rows(spark, df, "id", rows_per_second=50)
    q = s.writeStream.format("memory").queryName("cyc").outputMode("append") \
        .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start()
    import time
    deadline = time.time() + 60
    while time.time() < deadline and spark.sql("select count(*) from cyc").first()[0] < 10:
        time.sleep(1)
    q.stop()
    rows = spark.sql("select generator_step, id from cyc").collect()
    assert len(rows) >= 10
    assert all(r.id == (10, 20, 30)[r.generator_step % 3] for r in rows)


def test_json_lines_and_sorted_writer(spark, tmp_dir):
    df = spark.createDataFrame([(3, 7, "faq", None), (1, 2, "finance", "g")], S.TRUTH)
    p = os.path.join(tmp_dir, "jl")
    sk.write_sorted_json_lines(df, p, ["qid"])
    back = rd.read_json_lines(spark, p, S.TRUTH)
    assert [r.qid for r in back.collect()] == [1, 3]
    cp_ = os.path.join(tmp_dir, "corpus")
    sk.write_corpus(spark.createDataFrame([("f_1.pdf", "f", "x", 1, 1)], S.CORPUS), cp_)
    assert rd.read_corpus(spark, cp_).first().filename == "f_1.pdf"
