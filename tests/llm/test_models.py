import numpy as np
from pyspark.sql import functions as F

from conftest_llm import SF
from docloom.llm import quality, toxicity
from docloom.llm.linear import Sparse, fit_nnpu, sigmoid
from docloom.llm.queries import QUERIES

DOC = "doc_id long, text string, score string, row string, pattern string"


def _auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_on_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [got[r.doc_id].accepted for r in labels if r.quality == 1]
    bad = [got[r.doc_id].accepted for r in labels if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got.values())


def test_expectation_maximisation_recovers_planted_rates():
    rng = np.random.default_rng(0)
    n, catch, alarm = 60_000, np.array([0.5, 0.4, 0.3, 0.5, 0.2]), np.array([0.005, 0.002, 0.008, 0.001, 0.004])
    bad = rng.random(n) < 0.2
    v = np.where(rng.random((n, 5)) < np.where(bad[:, None], catch, alarm), quality.BAD, quality.GOOD).astype(np.int8)
    found, counts = np.unique(quality.pattern(v), return_counts=True)
    votes = (found[:, None] // 3 ** np.arange(5) % 3 - 1).astype(np.int8)
    model = quality.expectation_maximisation(votes, counts.astype(float))
    assert abs(model.good - 0.8) < 0.03 and np.abs(model.rates[:, 0, 0] - catch).max() < 0.05
    assert np.abs(model.rates[:, 1, 0] - alarm).max() < 0.005


def test_quality_edges(make):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "some usual words. they end."), (3, "x"), (4, "w " * 200_000), (5, "# $ % " * 50)]
    docs = make([(*r, "s", "r", "p") for r in rows], DOC)
    model = quality.fit(docs)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    kept = quality.accepted_documents(docs)
    assert kept.schema == docs.schema
    empty = make([], DOC)
    assert quality.accepted_documents(empty).count() == 0
    assert sigmoid(np.array([quality.fit(empty).bias]))[0] == 0.5
    assert quality.accepted_documents(make([(1, None, "s", "r", "p")], DOC)).count() == 1


def test_statistics_against_plain_python():
    import pyarrow as pa
    texts = ["A bb bb bb bb c! c? d, e f g h i j k l m n o p q r s t", "", "AAA bbb", "x # # # " * 10, None]
    rows = [(s.first + i, st[i], n[i]) for s in quality.scan(pa.array(texts), quality.NON_SPACE, quality.SAME, 16)
            for st, n in [quality.statistics(s)] for i in range(s.rows)]
    for r, st, n in rows:
        w = (texts[r] or "").split()
        letters = [c for c in texts[r] or "" if c.isalpha()]
        assert n == len(w) and abs(st[0] - sum(c.isupper() for c in letters) / max(1, len(letters))) < 1e-9
        if len(w) >= 20:
            assert abs(st[2] - sum(a == b for a, b in zip(w, w[1:])) / len(w)) < 1e-9
            assert abs(st[3] - sum(not any(c.isalpha() for c in x) for x in w) / len(w)) < 1e-9
            assert abs(st[5] - max(w.count(x) for x in w) / len(w)) < 1e-9
            assert abs(st[7] - sum(w[i] == w[i - 1] == w[i - 2] == w[i - 3] for i in range(3, len(w))) / len(w)) < 1e-9


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    pairs = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(p, y) for p, y in pairs if p.held_out]
    y = np.array([y for _, y in held])
    assert _auc(np.array([p.score for p, _ in held]), y) > 0.95
    predicted = np.array([p.predicted for p, _ in held])
    assert predicted[y == 1].mean() > 0.8 and predicted[y == 0].mean() < 0.01


def test_toxicity_learns_nothing_from_held_out_rows_or_the_other_columns(make):
    rows = [(i, f"usual words {i % 7} here" + (" vile nasty" if i % 5 == 0 else "")) for i in range(400)]
    docs = make(rows, "doc_id long, text string")
    learn = F.col("doc_id") < 300
    labels = [(i, int(i % 5 == 0)) for i in range(400)]
    flipped = [(i, 1 - y if i >= 300 else y) for i, y in labels]
    a, b = (toxicity.fit(docs, make(x, "doc_id long, toxic int"), learn) for x in (labels, flipped))
    assert (a.buckets == b.buckets).all() and np.allclose(a.weights, b.weights) and a.bias == b.bias
    out = {r["row"].doc_id: r.score for r in toxicity.score(docs, a).collect()}
    assert min(out[i] for i in range(0, 400, 5)) > 0.5 > max(out[i] for i in range(400) if i % 5)


def test_toxicity_edges(make):
    docs = make([(1, None, "s", "r", "p"), (2, "", "s", "r", "p"), (None, "a b", "s", "r", "p"), (2, "x " * 100_000, "s", "r", "p")], DOC)
    for labels in ([], [(1, None), (2, 0)], [(1, 1), (1, 0), (1, 1), (None, 1)], [(9, 1)]):
        model = toxicity.fit(docs, make(labels, "doc_id long, toxic int"), F.lit(True))
        out = toxicity.score(docs, model).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(make([], DOC), model).count() == 0
    assert toxicity.fit(make([], DOC), make([], "doc_id long, toxic int"), F.lit(True)).buckets.size == 0


def test_nnpu_risk_stays_above_zero():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.3
    pos = y & (rng.random(2000) < 0.5)
    x = np.where(y, 1.0, 0.0)
    cols, vals = np.tile([0, 1], 2000), np.stack([x, rng.random(2000)], 1).ravel()
    w, b = fit_nnpu(Sparse(np.repeat(np.arange(2000), 2), cols, vals, (2000, 2)), pos, 0.3)
    p = sigmoid(x * w[0] + vals[1::2] * w[1] + b)
    assert p[y].min() > 0.5 > p[~y].max()
