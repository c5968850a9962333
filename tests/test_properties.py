"""Property-based checks (hypothesis) against plain-Python definitions."""

import pytest

hyp = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from docloom.functions import spans as sp  # noqa: E402
from docloom.functions import text as tx  # noqa: E402

WORDS = st.lists(st.text(alphabet="ab中、及 ", min_size=0, max_size=4), max_size=6)


def py_join(xs):
    if not xs:
        return None
    if len(xs) == 1:
        return xs[0]
    return "、".join(xs[:-1]) + "及" + xs[-1]


@settings(max_examples=25, deadline=None)
@given(WORDS)
def test_join_cjk_list_property(spark, xs):
    df = spark.createDataFrame([(xs,)], "a array<string>")
    assert df.select(tx.join_cjk_list("a")).first()[0] == py_join(xs)


SPAN = st.tuples(st.integers(0, 30), st.integers(0, 30))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(SPAN, SPAN), min_size=1, max_size=20))
def test_span_overlap_property(spark, pairs):
    rows = [(a, b, c, d) for (a, b), (c, d) in pairs]
    df = spark.createDataFrame(rows, "s1 long, e1 long, s2 long, e2 long")
    got = [r[0] for r in df.select(sp.span_overlap("s1", "e1", "s2", "e2")).collect()]
    assert got == [len(set(range(a, b + 1)) & set(range(c, d + 1))) for a, b, c, d in rows]
