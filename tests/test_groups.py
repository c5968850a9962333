"""Callbacks per group, ordered segments, whole prompts, deep slices, charset scores."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docloom.operators import corpus as cp
from docloom.operators import features as fe
from docloom.operators import groups as gr
from docloom.operators import splits as sl
from docloom.sources import hooks as hk

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _list():
    return []


def _step(state, batch):
    names = batch.schema.names
    assert names == ["g", "key", "row"] and batch.num_rows <= gr.BATCH_ROWS
    return state + batch.column(names.index("row")).to_pylist()


def _merge(a, b):
    return a + b


def _out(state):
    return {"n": len(state), "rows": state}


def _fold(df, **how):
    return gr.fold_groups(df, ["g"], "key", _list, _step, _merge, _out, "n long, rows array<long>", **how)


def test_fold_equals_the_plain_group(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "hot", "hot", "hot", None]), draw.choice([None, *range(40)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, key long, row long")
    got = {r.g: (r.n, r.rows) for r in _fold(df, parts=16).collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        keys = {i: -1 if k is None else k for _, k, i in mine}
        assert got[g][0] == len(mine) and sorted(got[g][1]) == [r[2] for r in mine]
        order = [keys[i] for i in got[g][1]]
        assert order == sorted(order)
    assert len(got) == 3
    assert _fold(df.where("row < 0")).count() == 0


def test_hot_group_spans_tasks(spark, monkeypatch):
    # equal rows throughout: the state counts the stretches it was merged from
    df = spark.createDataFrame([("hot", 1, 1)] * 3000 + [("cold", 1, 1)], "g string, key long, row long")
    out = gr.fold_groups(df, ["g"], "key", _none, _count, _add, _parts, "n long, stretches long", parts=8).collect()
    assert {r.g: r.n for r in out} == {"hot": 3000, "cold": 1}
    assert next(r.stretches for r in out if r.g == "hot") >= 4


def _none():
    return (0, 1)


def _count(state, batch):
    return (state[0] + batch.num_rows, state[1])


def _add(a, b):
    return (a[0] + b[0], a[1] + b[1])


def _parts(state):
    return {"n": state[0], "stretches": state[1]}


@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
def test_segments_are_the_whole_in_order(spark, most):
    draw = random.Random(5)
    rows = [(g, i, draw.choice([None, "", "x" * draw.randint(1, 12) + str(i)])) for g in (1, 2, None) for i in range(40)]
    rows += [(9, i, None) for i in range(3)] + [(10, 0, "")]
    df = spark.createDataFrame(rows, "g long, i long, t string")
    out = gr.ordered_segments(df, ["g"], "i", F.col("t"), most).collect()
    for g in (1, 2, None, 9, 10):
        mine = sorted((r.segment_no, r.content) for r in out if r.g == g)
        texts = [t for h, _, t in rows if h == g and t is not None]
        longest = max(map(len, texts), default=0)
        assert "".join(c or "" for _, c in mine) == "".join(texts)
        assert all(len(c or "") < most + longest + 1 for _, c in mine)
        assert len(mine) == 1 or len("".join(texts)) > most
        if g == 9:
            assert mine == [(0, None)]
    assert gr.ordered_segments(df.where("i < 0"), ["g"], "i", F.col("t"), most).count() == 0


def test_one_segment_is_the_whole_value(spark):
    records = spark.createDataFrame([(1, 1, "q1", ["a"]), (1, 2, None, ["b", "c", "d"]), (1, 3, "q3", []), (2, 1, None, None)],
                                    "faqid long, rec long, question string, answers array<string>")
    whole = {r.doc_num: r.content for r in cp.faq_to_corpus(records).collect()}
    got = cp.faq_segments(records, 10_000)
    assert {r.doc_num: r.content for r in got.collect()} == whole and got.where("segment_no <> 0").count() == 0
    cut = sorted((r.doc_num, r.segment_no, r.content) for r in cp.faq_segments(records, 3).collect())
    assert {k: "".join(c for d, _, c in cut if d == k) for k in whole} == whole and len(cut) > 4
    pages = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (2, 1, "  "), (3, 1, None)], "doc_id long, page_no int, text string")
    assert ({r.doc_id: r.content for r in cp.pages_to_segments(pages, 1000).collect()}
            == {r.doc_id: r.content for r in cp.pages_to_document(pages).collect()})


def test_whole_prompts(spark):
    df = spark.createDataFrame([("q", "c", "faq_1"), (None, None, None)], "question string, context string, said string")
    roles = lambda **how: [[(m.role, m.content) for m in r.m] for r in df.select(fe.prompt_messages(**how).alias("m")).collect()]
    full, bare = roles(example="e", answer="said")
    assert [r for r, _ in full] == ["system", "user", "assistant", "user", "assistant"] and full[4][1] == "faq_1"
    assert full[3][1].endswith("<context>c</context>") and full[3][1].count("<context>") == 1
    assert [r for r, _ in bare] == ["system", "user", "assistant", "user"]
    assert [r for r, _ in roles()[0]] == ["system", "user"]
    assert roles(task="answer")[0][1][1] == "問題：q\n參考資料：c"
    with pytest.raises(ValueError):
        fe.prompt_messages(task="other")


def test_deep_slices_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("x"))
    shallow = sorted(map(tuple, sl.slice_rows(df, "x", 30, 90).collect()))
    monkeypatch.setattr(sl, "TOP_ROWS", 10)
    assert sorted(map(tuple, sl.slice_rows(df, "x", 30, 90).collect())) == shallow == sorted((199 - p, p) for p in range(30, 90))
    assert sl.slice_rows(df, "x", 190, 500).count() == 10 and sl.slice_rows(df, "x", 50, 50).count() == 0


def test_charset_scores():
    w = hk._weights()
    for text, score in (("", 0.0), ("abc", 1.0), ("一", 1.0), ("龘", 0.4), ("a一b", 0.5), ("é", 0.6), ("né", 1.0), ("\x01", -2.0),
                        ("", -2.0), ("\U00020000", -2.0), ("\U00010000", 0.0), ("ア", 1.0), ("\t", 1.0)):
        assert hk._commonness(text, w) == pytest.approx(score), text
