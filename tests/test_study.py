"""Study tables: commits, conflicts, repeatable reads, latest attempts."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from docloom.sources.study import CommitConflict, StudyTable


def _trials(spark, ids, value, attempt=0):
    return spark.createDataFrame([(i, float(value), attempt) for i in ids], "trial_id long, a double, attempt int")


def test_latest_attempt_and_versions(spark, tmp_dir):
    t = StudyTable(spark, tmp_dir + "/s")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.read(schema="study string, trial_id long, a double").count() == 0
    assert t.append(_trials(spark, [1, 2, None], 1), "x") == 1
    assert t.append(_trials(spark, [2], 3, 1).unionByName(_trials(spark, [2], 2, 0)), "x") == 2
    assert t.append(_trials(spark, [2], 9), "y") == 3
    assert sorted(((r.study, r.trial_id, r.a) for r in t.read().collect()), key=str) == \
        [("x", 1, 1.0), ("x", 2, 3.0), ("x", None, 1.0), ("y", 2, 9.0)]
    assert sorted(r.a for r in t.read(version=1).collect()) == [1.0, 1.0, 1.0]


def test_failed_append_is_invisible_and_commit_is_idempotent(spark, tmp_dir):
    t = StudyTable(spark, tmp_dir + "/s")
    t.append(_trials(spark, [1], 1), "x")
    part = t.stage(_trials(spark, [1, 2], 5), "x")
    assert [r.a for r in t.read().collect()] == [1.0]
    assert t.commit(part) == 2 and t.commit(part) == 2 and t.versions() == [1, 2]
    assert sorted(r.a for r in t.read().collect()) == [5.0, 5.0]


def test_two_writers_at_once_lose_nothing(spark, tmp_dir):
    tables = [StudyTable(spark, tmp_dir + "/s") for _ in range(8)]
    parts = [t.stage(_trials(spark, [i], i), "x") for i, t in enumerate(tables)]
    for t in tables:
        t.versions = lambda: []  # all start from the same, stale listing
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda x: x[0].commit(x[1]), zip(tables, parts, strict=True)))
    assert sorted(versions) == list(range(1, 9))
    assert sorted(r.a for r in StudyTable(spark, tmp_dir + "/s").read().collect()) == [float(i) for i in range(8)]
    with pytest.raises(CommitConflict):
        tables[0].commit(tables[0].stage(_trials(spark, [1], 1), "x"), retries=3)


def test_appends_may_add_columns(spark, tmp_dir):
    t = StudyTable(spark, tmp_dir + "/s")
    t.append(_trials(spark, [1], 1), "x")
    t.append(spark.createDataFrame([(2, "n")], "trial_id long, note string"), "x")
    assert {(r.trial_id, r.a, r.note) for r in t.read().collect()} == {(1, 1.0, None), (2, None, "n")}
