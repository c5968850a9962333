"""QA assembly: ordered lookup, first-match dedup, missing references."""

import pytest

from docloom.operators import features as fe
from docloom.operators import qa


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame([
        ("faq", 7, "first", 0), ("faq", 7, "second", 1), ("faq", 8, "eight", 2), ("finance", 7, "fin", 3),
    ], "category string, doc_num long, content string, ord long")


def test_ordered_context_and_first_match(spark, corpus):
    q = spark.createDataFrame([(1, "faq", [8, 7], "q1")], "qid long, category string, source array<long>, query string")
    out = qa.assemble_context(q, corpus, order_col="ord").first()
    assert out.context == '<article id="faq_8">eight</article><article id="faq_7">first</article>'


def test_missing_modes(spark, corpus):
    q = spark.createDataFrame([(1, "faq", [7, 99], "q"), (2, "faq", [], "q2")],
                              "qid long, category string, source array<long>, query string")
    miss = qa.missing_references(q, corpus).collect()
    assert [(r.qid, r.pos, r.doc_num) for r in miss] == [(1, 1, 99)]
    skipped = {r.qid: r.context for r in qa.assemble_context(q, corpus, order_col="ord", on_missing="skip").collect()}
    assert skipped == {1: '<article id="faq_7">first</article>', 2: ""}
    with pytest.raises(Exception, match="unresolved reference faq_99"):
        qa.assemble_context(q, corpus, order_col="ord", on_missing="fail").collect()


def test_competition_dataset(spark, corpus):
    q = spark.createDataFrame([(1, "faq", [7], "「x」")], "qid long, category string, source array<long>, query string")
    t = spark.createDataFrame([(1, 7, "faq", None)], "qid long, retrieve long, category string, generate string")
    r = qa.competition_dataset(q, t, corpus, order_col="ord").first().asDict()
    assert r == {"qid": 1, "category": "faq", "question": "『x』",
                 "context": '<article id="faq_7">first</article>', "answer_in_articleid": "faq_7"}
    only_q = qa.competition_dataset(q)
    assert "context" not in only_q.columns


def test_zip_by_order(spark):
    from docloom.operators.joins import zip_by_order
    a = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "k long, x string")
    b = spark.createDataFrame([(5, "B"), (1, "A"), (9, "C")], "j long, y string")
    got = sorted((r.row_no, r.x, r.y) for r in zip_by_order(a, "k", b, "j").collect())
    assert got == [(0, "a", "A"), (1, "b", "B"), (2, "c", "C")]


def test_file_name_and_labels(spark):
    from docloom.functions.text import prediction_file_name
    from docloom.operators.features import generative_labels
    df = spark.createDataFrame([(7, 0, 120, [[1, 2], [3]])], "q long, i int, c int, a array<array<int>>")
    assert df.select(prediction_file_name("q", "i", "c")).first()[0] == "qid7_iter0_checkpoint120.json"
    assert generative_labels(df, "a").first()["labels"] == [1, 2, 3]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_context_partition_invariance(spark, parts):
    import random
    rng = random.Random(5)
    corpus = spark.createDataFrame([(c, i, f"{c}{i}", rng.randint(0, 9)) for c in ("faq", "finance") for i in range(60)],
                                   "category string, doc_num long, content string, ord long")
    dup = spark.createDataFrame([("faq", 3, "dup", 99)], "category string, doc_num long, content string, ord long")
    corpus = corpus.unionByName(dup).repartition(parts)
    rows = [(q, rng.choice(["faq", "finance"]), rng.sample(range(60), rng.randint(0, 6)), "q") for q in range(80)]
    q = spark.createDataFrame(rows, "qid long, category string, source array<long>, query string").repartition(parts)
    got = {r.qid: r.context for r in qa.assemble_context(q, corpus, order_col="ord").collect()}
    for qid, cat, src, _ in rows:
        # the duplicate (faq, 3) has the largest order value, so the original wins
        exp = "".join(f'<article id="{cat}_{d}">{cat}{d}</article>' for d in src)
        assert got[qid] == exp


def test_inference_shuffles_texts_and_spans_but_no_windows(spark, capsys):
    import re

    from docloom.plans.catalog import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["inference_answers"](spark, "/root/testdata/sf0.001").explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", capsys.readouterr().out)
    assert len(sent) >= 3 and not any(re.search(r"\b(chunk|tokens|start_logits)#", x) for x in sent)


def test_windows_get_their_own_value_of_a_list(spark):
    df = spark.createDataFrame([(1, list("abcdefgh"), [[1], [], [2, 3]]), (2, ["x"], [[9], [8]])], "id int, tk array<string>, own array<array<int>>")
    got = fe.token_windows(df, "tk", width=4, overlap=2, along="own")
    assert got.columns == ["id", "chunk_no", "token_start", "chunk", "is_last", "own"]
    assert sorted((r.id, r.chunk_no, "".join(r.chunk), r.own) for r in got.collect()) == [
        (1, 0, "abcd", [1]), (1, 1, "cdef", []), (1, 2, "efgh", [2, 3]), (2, 0, "x", [9])]
