import random

import pytest

from conftest_llm import SF
from docloom.llm import tokencount
from docloom.llm.queries import QUERIES
from docloom.llm.tokencount import PATTERN, RANKS_FILE, apply_edits, build_trees

DOC = "doc_id long, text string, n_tokens string, edits string, of long"
COUNT = tokencount._count_with(RANKS_FILE, PATTERN)
SOME = ["a", "the", " ", "  ", "\n", " \n", "é", "'s", "12", "!!", "😀", "\t", " x", "word", "\r\n", "日本"]


@pytest.mark.parametrize("size, fan", [(1, 2), (16, 3), (128, 16)])
def test_trees_equal_counting_anew(monkeypatch, size, fan):
    monkeypatch.setattr(tokencount, "FAN", fan)
    monkeypatch.setattr(tokencount.cut, "__defaults__", (size,))
    rng = random.Random(size)
    for _ in range(300):
        text = "".join(rng.choice(SOME) for _ in range(rng.randint(0, 300)))
        tree = tokencount.grow(text, COUNT)
        for _ in range(4):
            assert tree.tokens == COUNT(text) and sum(x[0] for x in tree.levels[0]) == len(text)
            pos, removed = rng.randint(-2, len(text) + 2), rng.choice([0, 1, 3, 50])
            inserted = "".join(rng.choice(SOME) for _ in range(rng.choice([0, 1, 4, 80])))
            at = min(max(pos, 0), len(text))
            want = text[:at] + inserted + text[min(len(text), at + removed):]
            text, _ = tokencount.edit(text, tree, pos, removed, inserted, COUNT)
            assert text == want
        assert tree.tokens == COUNT(text)


def test_edits_of_a_table(make):
    long = "some words here, " * 5_000
    docs = make([(1, None, "n", "e", 1), (2, "", "n", "e", 1), (3, "one two three", "n", "e", 1), (3, "one two three", "n", "e", 1), (None, "null id", "n", "e", 1),
                 (4, long, "n", "e", 1), (5, "kept", "n", "e", 1)], DOC)
    edits = make([(1, 1, 0, 0, "new text"), (2, 1, 5, 5, "x"), (3, 2, 0, 4, ""), (3, 1, 100, 0, " four"), (None, 1, 0, 4, "?"), (4, 1, 40_000, 9, "!!"),
                  (9, 1, 0, 1, "y"), (5, 1, None, None, None)], "doc_id long, seq int, pos int, removed int, inserted string")
    out = apply_edits(build_trees(docs), edits).collect()
    got = {r.doc_id: r for r in out}
    want = {1: "new text", 2: "x", 3: "two three four", None: "null id", 4: long[:40_000] + "!!" + long[40_009:], 5: "kept"}
    assert len(out) == 7 and {i: r.text for i, r in got.items()} == want
    assert all(r.n_tokens == COUNT(r.text) and sum(r.tree.tokens) == r.n_tokens for r in out)
    assert 0 < got[4].n_encoded < 1_500 and got[5].n_encoded == 0 and got[4].n_before == COUNT(long)
    assert apply_edits(build_trees(make([], DOC)), edits).count() == 0
    assert apply_edits(build_trees(docs), edits.where("false")).where("n_tokens <> n_before").count() == 0


def test_query_against_counting_anew(spark):
    got = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        x = r.text or ""
        a = len(x) // 3
        y = x[:a] + f" {r.source} {r.lang}" + x[a + len(x) // 100 + 1:]
        assert (got[r.doc_id].n_before, got[r.doc_id].n_after) == (COUNT(x), COUNT(y[10:] + x[:10]))
