"""Span, window and decode functions (FIXTURES §3 cases + brute force)."""

import random

import pytest

from docloom.functions import spans as sp
from docloom.operators import decode as dc
from docloom.operators import features as fe


def test_subsequence_golden(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2], [1, 2]), ([1, 2, 3], [9]), ([1, 2], [1, 2, 3, 4, 5, 6]),
                                ([5, 5, 5], [5, 5])], "t array<int>, g array<int>")
    rows = df.select(sp.find_subsequence("t", "g").alias("m"), sp.answer_span("t", "g").alias("a")).collect()
    assert (rows[0].m.starts, rows[0].m.ends, rows[0].m.found) == ([0, 3], [2, 5], True)
    assert (rows[0].a.start, rows[0].a.end, rows[0].a.found) == (0, 2, True)
    for r in rows[1:3]:
        assert (r.m.starts, r.m.ends, r.m.found) == ([0], [0], False)
        assert (r.a.start, r.a.end, r.a.found) == (0, 0, False)
    assert rows[3].m.starts == [0, 1]


def test_subsequence_random(spark):
    rng = random.Random(3)
    data = []
    for _ in range(300):
        t = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
        g = [rng.randint(0, 3) for _ in range(rng.randint(1, 3))]
        data.append((t, g))
    df = spark.createDataFrame(data, "t array<int>, g array<int>")
    got = df.select("t", "g", sp.find_subsequence("t", "g").alias("m")).collect()
    for r in got:
        t, g = r.t, r.g
        starts = [i for i in range(len(t) - len(g) + 1) if t[i:i + len(g)] == g]
        assert r.m.starts == (starts or [0])
        assert r.m.ends == ([s + len(g) for s in starts] or [0])


def test_match_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2], [1, 2])], "t array<int>, g array<int>")
    assert df.select(sp.match_mask("t", "g")).first()[0] == [True, True, False, True, True]


@pytest.mark.parametrize("n,expected", [(4, 1), (5, 1), (6, 2), (8, 2), (9, 3), (0, 1)])
def test_window_counts(spark, n, expected):
    df = spark.createDataFrame([(list(range(n)),)], "t array<int>")
    out = fe.token_windows(df, "t", width=5, overlap=2).collect()
    assert len(out) == expected
    covered = sorted({x for r in out for x in r.chunk})
    assert covered == list(range(n))
    for a, b in zip(out, out[1:]):
        assert a.chunk[-2:] == b.chunk[:2]  # consecutive windows overlap by exactly 2


def test_window_prompt(spark):
    df = spark.createDataFrame([(list(range(10)), [-1, -2])], "t array<int>, p array<int>")
    out = fe.token_windows(df, "t", width=0, overlap=1, prompt="p", max_length=6).collect()
    assert [r.chunk for r in out] == [[-1, -2, 0, 1, 2, 3], [-1, -2, 3, 4, 5, 6], [-1, -2, 6, 7, 8, 9]]
    assert [r.is_last for r in out] == [False, False, True]


def test_reversed_span_and_argmax(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0],
                                 [0.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0])],
                               "start_logits array<float>, end_logits array<float>")
    r = dc.decode(df).first()
    assert (r.pred_start, r.pred_end) == (4, 9)
    assert 0 < r.start_confidence < 1
    ties = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<float>")
    assert ties.select(sp.argmax("a")).first()[0] == 1


def test_span_metrics_golden(spark):
    df = spark.createDataFrame([(2, 5, 4, 7)], "pred_start long, pred_end long, true_start long, true_end long")
    r = dc.span_metrics(df).first()
    assert (r.precision, r.recall, r.exact_match) == (0.5, 0.5, 0.0)


def test_span_metrics_brute(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        a, b = sorted([rng.randint(0, 20), rng.randint(0, 20)])
        c, d = rng.randint(0, 20), rng.randint(0, 25)
        rows.append((a, b, c, d))
    df = spark.createDataFrame(rows, "pred_start long, pred_end long, true_start long, true_end long")
    r = dc.span_metrics(df).first()
    ps, rs, ex = [], [], []
    for a, b, c, d in rows:
        p, t = set(range(a, b + 1)), set(range(c, d + 1))
        if p:
            ps.append(len(p & t) / len(p))
        if t:
            rs.append(len(p & t) / len(t))
        ex.append(1.0 if (a, b) == (c, d) else 0.0)
    assert r.precision == pytest.approx(sum(ps) / len(ps))
    assert r.recall == pytest.approx(sum(rs) / len(rs))
    assert r.exact_match == pytest.approx(sum(ex) / len(ex))


def test_widening_attempts():
    assert dc.widening_attempts(5, 20) == [(0, 0), (5, 5), (10, 15), (15, 30), (20, 50), (25, 75)]
    assert [i for i, _ in dc.widening_attempts(5, 25)][-1] == 30


def brute_widen(tokens, s, e, step=5, limit=20):
    import re
    pat = re.compile(r"(?:insurance|finance|faq)_[0-9]+")
    incre = 0
    while True:
        lo, hi = max(s, 0), min(e, len(tokens) - 1)
        m = pat.findall(" ".join(tokens[lo:hi + 1])) if hi >= lo else []
        if m or incre > limit:
            break
        incre += step
        s = 0 if s - incre <= 0 else s - incre
        e = e + incre
    return (m[0], incre) if m else None


def test_widening_brute(spark):
    rng = random.Random(11)
    data = []
    for i in range(400):
        n = rng.randint(1, 120)
        toks = ["w"] * n
        if rng.random() < 0.8:
            toks[rng.randrange(n)] = f"faq_{i}"
        s = rng.randrange(n)
        data.append((i, toks, s, s + rng.randint(0, 3)))
    df = spark.createDataFrame(data, "i int, tokens array<string>, pred_start long, pred_end long")
    got = {r.i: (r.match, r.incre_num_by) for r in
           dc.widening_search(df, tokens="tokens", keep_misses=True).collect()}
    for i, toks, s, e in data:
        exp = brute_widen(toks, s, e)
        assert got[i] == (exp if exp else (None, None)), i


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [1]), (1, [4, 5])], "batch_no long, t array<int>")
    rows = sorted(fe.pad_batches(df, "t").collect(), key=lambda r: (r.batch_no, -len(r.t)))
    assert rows[0].input_ids == [1, 2, 3] and rows[1].input_ids == [1, 0, 0]
    assert rows[1].attention_mask == [1, 0, 0] and rows[2].input_ids == [4, 5]


def test_window_prompt_too_long(spark):
    df = spark.createDataFrame([(list(range(10)), [-1, -2, -3, -4])], "t array<int>, p array<int>")
    with pytest.raises(Exception, match="leaves no room"):
        fe.token_windows(df, "t", width=0, overlap=2, prompt="p", max_length=6).collect()


def test_answer_span_random(spark):
    rng = random.Random(13)
    data = []
    for _ in range(400):
        t = [rng.choice(["a", "b", "ab", "c", "中"]) for _ in range(rng.randint(0, 15))]
        g = [rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(1, 3))]
        data.append((t, g))
    df = spark.createDataFrame(data, "t array<string>, g array<string>")
    for r in df.select("t", "g", sp.answer_span("t", "g").alias("a")).collect():
        starts = [i for i in range(len(r.t) - len(r.g) + 1) if r.t[i:i + len(r.g)] == r.g]
        exp = (starts[0], starts[0] + len(r.g), True) if starts else (0, 0, False)
        assert (r.a.start, r.a.end, r.a.found) == exp, (r.t, r.g)
    ints = spark.createDataFrame([([1, 12, 2, 1, 2], [1, 2])], "t array<int>, g array<int>")
    a = ints.select(sp.answer_span("t", "g").alias("a")).first().a
    assert (a.start, a.end, a.found) == (3, 5, True)


def test_window_properties_random(spark):
    """For random (n, width, overlap): windows start at 0, step width−overlap,
    cover every token, consecutive windows share exactly `overlap` tokens, and
    the last window reaches the end."""
    rng = random.Random(21)
    cases = []
    for i in range(300):
        w = rng.randint(2, 12)
        o = rng.randint(0, w - 1)
        cases.append((i, list(range(rng.randint(0, 60))), w, o))
    got = {}
    for w in sorted({c[2] for c in cases}):
        for o in sorted({c[3] for c in cases if c[2] == w}):
            sub = [(i, t) for i, t, ww, oo in cases if ww == w and oo == o]
            df = spark.createDataFrame(sub, "i int, t array<int>")
            for r in fe.token_windows(df, "t", width=w, overlap=o).collect():
                got.setdefault(r.i, []).append((r.chunk_no, r.chunk, r.is_last))
    for i, t, w, o in cases:
        ch = sorted(got[i])
        assert [c[0] for c in ch] == list(range(len(ch)))
        assert sorted({x for _, c, _ in ch for x in c}) == t
        for (_, a, _), (_, b, _) in zip(ch, ch[1:]):
            assert a[len(a) - o:] == b[:o] if o else True
            assert len(a) == w
        assert ch[-1][2] and all(not c[2] for c in ch[:-1])
        expected = 1 if len(t) <= w else 1 + -(-(len(t) - w) // (w - o))
        assert len(ch) == expected
