"""Small operators without a query of their own."""

import pandas as pd
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx
from docloom.operators import collect as co
from docloom.operators import features as fe
from docloom.operators import splits
from docloom.sources import hooks as hk
from docloom.streaming import collect as sc


def test_first_row_and_sorted_answers(spark):
    df = spark.createDataFrame([(3, 1), (1, 9), (1, 2)], "qid int, retrieve int")
    assert splits.first_row(df, "qid").first().qid == 1
    assert [tuple(r) for r in co.sorted_answers(df).collect()] == [(1, 2), (1, 9), (3, 1)]


def test_span_ids(spark):
    df = spark.createDataFrame([(2, 5), (4, 3)], "s long, e long")
    assert [r[0] for r in df.select(sp.span_ids("s", "e")).collect()] == [[2, 3, 4, 5], []]


def test_all_windows_of_one_example(spark):
    df = spark.createDataFrame([(list(range(9)),)], "t array<int>")
    assert [r.chunk for r in fe.token_windows(df, "t", width=5, overlap=2).collect()] == [
        [0, 1, 2, 3, 4], [3, 4, 5, 6, 7], [6, 7, 8]]


def test_stateless_map_over_a_stream(spark, tmp_dir):
    """The library's row functions are DataFrame functions; on a stream as on a table."""
    spark.createDataFrame([("中 文",), ("a b",)], "text string").write.mode("overwrite").parquet(tmp_dir + "/in")
    stream = spark.readStream.schema("text string").parquet(tmp_dir + "/in")
    q = (stream.select(tx.despace_cjk("text").alias("text")).writeStream.trigger(availableNow=True)
         .option("checkpointLocation", tmp_dir + "/ck").format("parquet").option("path", tmp_dir + "/out").start())
    q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(tmp_dir + "/out").collect()) == ["a b", "中文"]


def test_map_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")

    def double(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(k=pdf.k * 2)
    got = sorted(r.k for r in hk.map_batches(df, double, "k long, v string").collect())
    assert got == [2, 4]


def test_fill_defaults(spark):
    df = spark.createDataFrame([("x", None)], "context string, question string")
    r = fe.fill_defaults(df, {"question": "q?", "answer_in_articleid": "a_1"}).first()
    assert (r.context, r.question, r.answer_in_articleid) == ("x", "q?", "a_1")


def test_model_input_and_char_tokens(spark):
    df = spark.createDataFrame([("P", "ctx", "中文a")], "p string, c string, t string")
    assert df.select(fe.model_input("p", "c")).first()[0] == "P<context>ctx</context>"
    assert df.select(fe.char_tokens("t")).first()[0] == ["中", "文", "a"]


def test_tokenize_hook(spark):
    """F21 hook: a per-row tokenizer library inside an Arrow-batched pandas_udf."""
    tokenizers = __import__("pytest").importorskip("tokenizers")
    from tokenizers.pre_tokenizers import Whitespace

    def tok(s: pd.Series) -> pd.Series:
        pre = Whitespace()
        return s.map(lambda v: [t for t, _ in pre.pre_tokenize_str(v)])

    df = spark.createDataFrame([("see faq_12, then stop.",)], "text string")
    out = fe.tokenize_with(df, "text", tok, name="tokens", return_type="array<string>").first().tokens
    assert out == ["see", "faq_12", ",", "then", "stop", "."]
    assert tokenizers is not None
