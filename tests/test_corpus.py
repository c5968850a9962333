"""Corpus building: file names, fallback, FAQ content, union, pages."""

import pytest

from docloom import schemas as S
from docloom.operators import corpus as cp


def test_parse_filename(spark):
    df = spark.createDataFrame([("finance_12.pdf",), ("insurance_a_3.pdf",)], "filename string")
    got = [(r.category, r.doc_num) for r in cp.parse_filename(df).collect()]
    assert got == [("finance", 12), ("insurance", 3)]


def test_fallback(spark):
    corpus = spark.createDataFrame([("f_1.pdf", "f", "short", 5, 1), ("f_2.pdf", "f", "x" * 60, 60, 2),
                                    ("f_3.pdf", "f", "y" * 60, 60, 3), ("f_4.pdf", "f", "", 0, 4)], S.CORPUS)
    fb = spark.createDataFrame([("f_1", "ok=text/!"), ("f_3", "blocked")], "stem string, text string")
    out = {r.doc_num: (r.content, r.content_len) for r in
           cp.apply_fallback(corpus, fb, blocklist=["f_3.pdf"], missing="keep").collect()}
    assert out[1] == ('<page number="0">oktext</page>', len('<page number="0">oktext</page>'))
    assert out[2][0] == "x" * 60 and out[3][0].startswith('<page number="0">blocked')
    assert out[4] == ("", 0)
    with pytest.raises(Exception, match="no fallback text for f_4.pdf"):
        cp.apply_fallback(corpus, fb, missing="fail").collect()


def test_faq(spark):
    turns = spark.createDataFrame([(7, 0, "user", "q1"), (7, 1, "assistant", "a"), (7, 2, "assistant", "b"),
                                   (7, 3, "user", "q2"), (7, 4, "assistant", "c"), (8, 0, "user", "lonely")],
                                  "conv_id long, turn long, role string, text string")
    got = {r.doc_num: r.content for r in cp.faq_to_corpus(cp.faq_records(turns)).collect()}
    assert got[7] == "問題：q1\nq2答案：a及b\nc"
    assert got[8] == "問題：lonely答案："


def test_union_and_pages(spark):
    a = spark.createDataFrame([("f_1.pdf", "f", "x", 1, 1)], S.CORPUS)
    b = spark.createDataFrame([("faq", "y", 1, 7)], "category string, content string, content_len int, doc_num long")
    u = cp.union_corpora(a, b).orderBy("doc_num").collect()
    assert [r.filename for r in u] == ["f_1.pdf", None]
    pages = spark.createDataFrame([(1, 0, " a "), (1, 1, "  "), (1, 2, "c"), (2, 0, "")],
                                  "doc_id long, page_no long, text string")
    got = {r.doc_id: r.content for r in cp.pages_to_document(pages).collect()}
    assert got == {1: '<page number="0">a</page><page number="2">c</page>', 2: None}
