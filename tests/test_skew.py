"""Hot keys: one key holding most rows still gives exact results, and the
bucketed rank really spreads a hot group over several buckets."""

from pyspark.sql import functions as F

from docloom.operators import collect as co
from docloom.operators import qa
from docloom.operators import ranks


def test_hot_document(spark):
    corpus = spark.createDataFrame([("faq", i, f"t{i}") for i in range(20)], "category string, doc_num long, content string")
    rows = [(q, "faq", [0] if q % 10 else [q % 20, 0], "x") for q in range(300)]   # doc 0 in every question
    q = spark.createDataFrame(rows, "qid long, category string, source array<long>, query string")
    got = {r.qid: r.context for r in qa.assemble_context(q, corpus, "content").collect()}
    assert len(got) == 300
    assert got[1] == '<article id="faq_0">t0</article>'
    assert got[10] == '<article id="faq_10">t10</article><article id="faq_0">t0</article>'


def test_hot_qid(spark):
    rows = [(7, "faq", str(i % 3), i % 11) for i in range(3000)] + [(8, "faq", "1", 4)]
    df = spark.createDataFrame(rows, "qid long, category string, retrieve string, incre_num_by int")
    got = sorted(tuple(r) for r in co.best_predictions(df).collect())
    assert got == [(7, "faq", "0", 0), (7, "faq", "1", 0), (7, "faq", "2", 0), (8, "faq", "1", 4)]


def test_hot_group_is_spread(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string")
    b = ranks.sorted_once(df, F.col("id").asc(), ["g"], 8)
    assert b.where(F.col("g") == "hot").select(ranks.PART).distinct().count() >= 4
    r = {x.id: x.rank for x in ranks.rank_within(df, "id", ["g"], n_buckets=8).collect()}
    hot = sorted(i for i, g in rows if g == "hot")
    assert [r[i] for i in hot] == list(range(len(hot)))
