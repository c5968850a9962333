"""Splits: stratified folds vs the plain-Python definition, exact ranks,
batches and partition invariance (1, 4, 17 partitions)."""

import random
from collections import Counter

import pytest

from docloom.operators import ranks, splits


def folds_spec(labels, k):
    """Stratified k-fold without shuffle, straight from its definition."""
    first = {}
    for i, y in enumerate(labels):
        first.setdefault(y, len(first))
    enc = [first[y] for y in labels]
    order = sorted(enc)
    alloc = [Counter(order[i::k]) for i in range(k)]
    out = [None] * len(labels)
    for c in range(len(first)):
        blocks = [f for f in range(k) for _ in range(alloc[f][c])]
        idx = [i for i, e in enumerate(enc) if e == c]
        for j, i in enumerate(idx):
            out[i] = blocks[j]
    return out


@pytest.mark.parametrize("k,seed", [(2, 1), (3, 2), (5, 3), (7, 4)])
def test_folds_match_spec(spark, k, seed):
    rng = random.Random(seed)
    labels = [rng.choice("abcd") if rng.random() < 0.8 else "e" for _ in range(rng.randint(30, 300))]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, y string")
    got = {r.id: r.fold for r in splits.stratified_folds(df, "y", "id", k=k, n_buckets=5).collect()}
    assert [got[i] for i in range(len(labels))] == folds_spec(labels, k)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partition_invariance(spark, parts):
    rng = random.Random(9)
    rows = [(i * 3 + 1, rng.choice("xyz")) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, y string").repartition(parts)
    r = {x.id: x.rank for x in ranks.rank_within(df, "id", ["y"], n_buckets=7).collect()}
    for y in "xyz":
        ids = sorted(i for i, yy in rows if yy == y)
        assert [r[i] for i in ids] == list(range(len(ids)))
    b = splits.batch_numbers(df, "id", 16, n_buckets=3).collect()
    ids = sorted(i for i, _ in rows)
    pos = {i: n for n, i in enumerate(ids)}
    assert all(x.batch_no == pos[x.id] // 16 and x.pos_in_batch == pos[x.id] % 16 for x in b)
    f = {x.id: x.fold for x in splits.stratified_folds(df, "y", "id", k=5).collect()}
    labels_in_order = [y for _, y in sorted(rows)]
    assert [f[i] for i in ids] == folds_spec(labels_in_order, 5)


def test_rank_descending_and_slice(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "qid long")
    got = splits.slice_rows(df, "qid", 5, 10, descending=True).orderBy("position").collect()
    assert [r.qid for r in got] == [44, 43, 42, 41, 40]
    assert [r.position for r in got] == [5, 6, 7, 8, 9]


def test_epoch_replay_and_fold_split(spark):
    df = spark.createDataFrame([(i,) for i in (3, 1, 2)], "id long")
    rows = sorted((r.step, r.id) for r in splits.epoch_replay(df, "id", 2).collect())
    assert rows == [(0, 1), (1, 2), (2, 3), (3, 1), (4, 2), (5, 3)]
    f = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, fold int")
    tr, te = splits.fold_split(f, 0)
    assert tr.count() == 6 and te.count() == 3


def test_seeded_shuffle_deterministic(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id long")
    a = [r.id for r in splits.seeded_shuffle(df.repartition(3), "id").orderBy("shuffle_key").collect()]
    b = [r.id for r in splits.seeded_shuffle(df.repartition(11), "id").orderBy("shuffle_key").collect()]
    assert a == b and sorted(a) == list(range(100)) and a != list(range(100))


@pytest.mark.parametrize("parts", [1, 5])
def test_running_max_buckets(spark, parts):
    rng = random.Random(4)
    rows = [(g, t, rng.choice([None, rng.randint(0, 50)])) for g in "ab" for t in range(200)]
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(parts)
    got = {(r.g, r.t): r.running_max for r in ranks.running_max_within(df, "v", "t", ["g"], n_buckets=6).collect()}
    for g in "ab":
        cur = None
        for _, t, v in sorted(x for x in rows if x[0] == g):
            if v is not None:
                cur = v if cur is None else max(cur, v)
            assert got[(g, t)] == cur


@pytest.mark.parametrize("how,inclusive", [("sum", False), ("sum", True), ("min", True), ("max", False)])
def test_running_within(spark, how, inclusive):
    rng = random.Random(8)
    rows = [(g, t, rng.randint(-20, 20)) for g in "ab" for t in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    got = {(r.g, r.t): r.running for r in
           ranks.running_within(df, "v", "t", ["g"], how=how, inclusive=inclusive, n_buckets=7).collect()}
    fn = {"sum": sum, "min": min, "max": max}[how]
    for g in "ab":
        seq = sorted((t, v) for gg, t, v in rows if gg == g)
        for i, (t, _) in enumerate(seq):
            vals = [v for _, v in seq[: i + 1 if inclusive else i]]
            exp = fn(vals) if vals else (0 if how == "sum" else None)
            assert got[(g, t)] == exp
