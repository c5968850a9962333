"""Text functions: golden cases (FIXTURES §3) and randomised equivalence
against plain Python ``re`` semantics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx


def one(spark, col_fn, value, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_fn(F.col("s")).alias("o")).first()["o"]


def many(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", col_fn(F.col("s")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("src,once,fix", [
    ("中 文 字", "中文 字", "中文字"),
    ("中     文", "中     文", "中     文"),
    ("𠀁 中", "𠀁 中", "𠀁中"),
    ("a 中 b", "a 中 b", "a 中 b"),
    ("中\t\n文", "中文", "中文"),
    ("中\x1c文", "中文", "中文"),
])
def test_despace_golden(spark, src, once, fix):
    assert one(spark, tx.despace_cjk_once, src) == once
    assert one(spark, tx.despace_cjk, src) == fix


def test_null_passthrough(spark):
    for fn in (tx.despace_cjk_once, tx.despace_cjk, tx.clean_text, tx.remove_junk, tx.drop_blank_lines):
        assert one(spark, fn, None) is None


def test_blank_lines_and_brackets(spark):
    assert one(spark, tx.drop_blank_lines, "a\n \n\nb") == "a\nb"
    assert one(spark, tx.fold_brackets, "甲 ( 乙 ) 丙") == "甲（乙）丙"
    assert one(spark, tx.clean_text, "甲 ( 乙 ) 丙") == "甲（乙）丙"
    assert one(spark, tx.clean_text, "  x / y \n\n") == "x／y"


def test_junk_order(spark):
    assert one(spark, tx.remove_junk, "f??") == "?"
    assert one(spark, tx.remove_junk, "一二三I!") == "三"
    assert one(spark, tx.remove_junk, "a****b") == "ab"


def test_list_join(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],), (None,)], "a array<string>")
    got = [r[0] for r in df.select(tx.join_cjk_list("a")).collect()]
    assert got == ["a", "a及b", "a、b及c", None, None]


def test_tags_and_ids(spark):
    df = spark.createDataFrame([("faq", 7, "x")], "c string, n long, t string")
    assert df.select(tx.article_tag("c", "n", "t")).first()[0] == '<article id="faq_7">x</article>'
    assert df.select(tx.page_tag(F.lit(0), "t")).first()[0] == '<page number="0">x</page>'
    assert one(spark, tx.first_doc_id, "see finance_12 and faq_3") == "finance_12"
    assert one(spark, tx.first_doc_id, "nothing here") is None
    d = spark.createDataFrame([("faq_12",)], "s string").select(tx.split_doc_id("s").alias("p")).first()["p"]
    assert (d["category"], d["number"]) == ("faq", "12")


# --- randomised equivalence against Python's own regex semantics ----------

PY_WS = r"\s"  # Python str patterns: Unicode whitespace


def _py_class(ranges, singles=""):
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else re.escape(chr(a)) for a, b in ranges) + \
        "".join(re.escape(c) for c in singles)


PY_ONCE = re.compile(f"([{_py_class(tx.CJK_RANGES_SINGLE_PASS)}]){PY_WS}{{1,4}}([{_py_class(tx.CJK_RANGES_SINGLE_PASS)}])")
C2 = _py_class(tx.CJK_RANGES_FIXPOINT, tx.CJK_SINGLES_FIXPOINT)
PY_FIX = re.compile(f"([{C2}]){PY_WS}{{1,4}}([{C2}])")
PY_BLANK = re.compile(r"^\s*$\n", re.MULTILINE)


def py_fixpoint(s):
    while True:
        o = PY_FIX.sub(r"\1\2", s).strip()
        if o == s:
            return o
        s = o


def py_clean(s):
    s = PY_BLANK.sub("", s)
    for a, b in tx.BRACKET_FOLDS:
        s = s.replace(a, b)
    return py_fixpoint(s)


ALPHABET = (list("中文字一〆，。（）") + ["\U00020001", "\U0002A700", "　", " ", "\t", "\n", "\x1c", "\xa0",
                                        "a", "b", "(", ")", "/", " "])


def rand_strings(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.randint(0, 24)
        s = "".join(rng.choice(ALPHABET) for _ in range(k))
        if rng.random() < 0.3:
            s = s.replace(" ", " ( ", 1)
        out.append(s)
    return out


def test_random_equivalence(spark):
    vals = rand_strings(1500, 7)
    assert many(spark, tx.despace_cjk_once, vals) == [PY_ONCE.sub(r"\1\2", v) for v in vals]
    assert many(spark, tx.despace_cjk, vals) == [py_fixpoint(v) for v in vals]
    assert many(spark, tx.drop_blank_lines, vals) == [PY_BLANK.sub("", v) for v in vals]
    assert many(spark, tx.clean_text, vals) == [py_clean(v) for v in vals]
    assert many(spark, tx.strip_space, vals) == [v.strip() for v in vals]


def test_render(spark):
    df = spark.createDataFrame([("q%1",)], "q string")
    assert df.select(tx.render("A {q} B 100%", q="q")).first()[0] == "A q%1 B 100%"
    assert df.select(tx.render("A {q}", q=F.lit(None).cast("string"))).first()[0] is None
    assert df.select(tx.first_doc_id(F.lit("see faq_１２ there"))).first()[0] == "faq_１２"
