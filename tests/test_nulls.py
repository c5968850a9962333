"""NULL group and order keys: every row comes back, from ranks, folds, batches,
epochs, zips, windows and FAQ records; first matches and repeated questions."""

from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.operators import corpus as cp
from docloom.operators import joins, qa, ranks, splits, trials

ROWS = [(i, None if i % 5 == 0 else "ab"[i % 2], None if i % 7 == 0 else i) for i in range(60)]


def _df(spark, parts=4):
    return spark.createDataFrame(ROWS, "id long, g string, o long").repartition(parts)


def test_rank_within_keeps_null_groups_and_orders(spark):
    for keys in ((), ("g",)):
        got = ranks.rank_within(_df(spark), "o", keys, n_buckets=3).collect()
        assert sorted(r.id for r in got) == list(range(60))
        for g in ({r.g for r in got} if keys else {0}):
            part = sorted((r for r in got if not keys or r.g == g), key=lambda r: r.rank)
            assert [r.rank for r in part] == list(range(len(part)))
            orders = [r.o for r in part]
            assert orders == sorted(orders, key=lambda x: (x is not None, x or 0))
    down = sorted(ranks.rank_within(_df(spark), "o", descending=True).collect(), key=lambda r: r.rank)
    assert [r.o for r in down] == sorted((r.o for r in down), key=lambda x: (x is None, -(x or 0)))


def test_running_within_keeps_null_groups(spark):
    got = ranks.running_within(_df(spark), "id", "id", ["g"], how="sum", name="s", n_buckets=3).collect()
    assert len(got) == 60
    for r in got:
        assert r.s == sum(i for i, g, _ in ROWS if g == r.g and i <= r.id)


def test_folds_batches_epochs_and_zip_keep_null_rows(spark):
    folds = splits.stratified_folds(_df(spark), "g", "id", k=5).collect()
    assert sorted(r.id for r in folds) == list(range(60))
    for g in {r.g for r in folds}:
        sizes = [sum(r.fold == f and r.g == g for r in folds) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    b = splits.batch_numbers(_df(spark), "o", 8).collect()
    assert len(b) == 60 and sorted(r.batch_no * 8 + r.pos_in_batch for r in b) == list(range(60))
    e = splits.epoch_replay(_df(spark), "o", 2).collect()
    assert sorted(r.step for r in e) == list(range(120))
    z = joins.zip_by_order(_df(spark).select("o"), "o", _df(spark).select(F.col("id").alias("x")), "x").collect()
    assert len(z) == 60
    top = splits.slice_rows(_df(spark), "id", 5, 9, descending=True).collect()
    assert sorted((r.position, r.id) for r in top) == [(5, 54), (6, 53), (7, 52), (8, 51)]
    then = splits.slice_then_sort(_df(spark), "id", 5, 9, "id").collect()
    assert sorted((r.position, r.id) for r in then) == [(0, 8), (1, 7), (2, 6), (3, 5)]


def test_faq_records_keep_turns_of_a_null_conversation(spark):
    turns = spark.createDataFrame([(None, 1, "user", "q"), (None, 2, "assistant", "a"), (1, 1, "user", "r"), (1, 2, "assistant", "b")],
                                  "conv_id long, turn long, role string, text string")
    assert sorted((r.faqid or 0, r.question, r.answers) for r in cp.faq_records(turns).collect()) == [(0, "q", ["a"]), (1, "r", ["b"])]


def test_pareto_front_with_ties(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (2.0, 4.0), (2.0, 6.0), (3.0, 4.0), (None, 1.0)], "a double, b double")
    got = sorted((r.a, r.b) for r in trials.pareto_front(df, {"a": "min", "b": "min"}, n_buckets=2).collect())
    assert got == [(1.0, 5.0), (1.0, 5.0), (2.0, 4.0)]


def test_first_match_and_one_context_per_question_row(spark):
    corpus = spark.createDataFrame([("faq", 10, "A2", 2), ("faq", 10, "A", 1), ("faq", 11, "B", None)],
                                   "category string, doc_num long, content string, ord int")
    q = spark.createDataFrame([(1, "faq", [10, 11], "x"), (2, "faq", None, "y")], "qid long, category string, source array<long>, query string")
    t = spark.createDataFrame([(1, "faq", 10, None), (1, "faq", 11, None)], "qid long, category string, retrieve long, generate string")
    got = qa.competition_dataset(q, t, corpus, order_col="ord").collect()
    assert sorted(r.answer_in_articleid for r in got) == ["faq_10", "faq_11"]
    assert {r.context for r in got} == {'<article id="faq_10">A</article><article id="faq_11">B</article>'}
    twice = q.unionByName(spark.createDataFrame([(1, "faq", [11], "x")], q.schema))
    contexts = {tuple(r.source or ()): r.context for r in qa.assemble_context(twice, corpus, "ord").collect()}
    assert contexts[(11,)] == '<article id="faq_11">B</article>' and contexts[()] == ""


def test_null_tokens_keep_their_place(spark):
    df = spark.createDataFrame([(["a", None, "b", "c"], ["b", "c"]), (["a", None, "b"], ["a", "b"]), ([None, "a"], [None, "a"])],
                               "t array<string>, g array<string>")
    assert [r[0] for r in df.select(sp.earliest_match("t", "g")).collect()] == [2, -1, -1]
