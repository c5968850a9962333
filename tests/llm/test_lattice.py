import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest_llm import SF
from docloom.llm.lattice import BYTES, GO_ON, PieceModel, score_texts
from docloom.llm.pieces import load_pieces
from docloom.llm.queries import QUERIES

DOC = "doc_id long, text string, block long, word string, learn boolean"
PIECES = [(0, "▁", math.log(0.1)), (1, "▁a", math.log(0.2)), (2, "a", math.log(0.2)), (3, "ab", math.log(0.1)),
          (4, "b", math.log(0.2)), (5, "bab", math.log(0.1)), (6, "▁ab", math.log(0.1))]


def every_way(word, pieces):
    """Sum over all segmentations by listing them; expected piece counts."""
    first = sum(math.exp(s) for _, p, s in pieces if p[0] == "▁")
    rest_of = sum(math.exp(s) for _, p, s in pieces if p[0] != "▁")

    def ways(rest):
        if not rest:
            yield 1.0, ()
            return
        for i, (_, p, s) in enumerate(pieces):
            if rest.startswith(p):
                for q, used in ways(rest[len(p):]):
                    yield math.exp(s) / (first if p[0] == "▁" else rest_of) * (1 - BYTES) * GO_ON * q, (i, *used)
        for q, used in ways(rest[1:]):
            yield (BYTES / 256 * GO_ON) ** len(rest[0].encode()) * q, used
    total, counts = 0.0, Counter()
    for q, used in ways("▁" + word):
        total += q
        for i in used:
            counts[i] += q
    return total * (1 - GO_ON) / GO_ON, {i: c / total for i, c in counts.items()}


def test_marginals_and_expected_counts_equal_all_segmentations():
    words = ["a", "ab", "abab", "bab", "é", "aéb", "b", "aaaa", "😀a"]
    model = PieceModel(PIECES)
    got = model.log_marginal(pa.array(words))
    total = np.zeros(len(PIECES))
    for w, x in zip(words, got.tolist(), strict=True):
        q, counts = every_way(w, PIECES)
        assert abs(math.log(q) - x) < 1e-9, w
        for i, c in counts.items():
            total[i] += 2 * c
    assert np.allclose(model.expected_counts(pa.array(words), np.full(len(words), 2.0)), total, rtol=1e-6)
    assert model.log_marginal(pa.array([], pa.string())).size == 0


def test_marginal_is_a_probability():
    """Words over the pieces' letters, short ones: their marginals add up to less than 1."""
    import itertools
    model = PieceModel(PIECES)
    words = ["".join(x) for k in range(1, 9) for x in itertools.product("ab", repeat=k)]
    assert 0.3 < np.exp(model.log_marginal(pa.array(words))).sum() < 1


def _brute(rows, learns):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for _, t in rows]
    c, ends = Counter(), 0
    for (i, _), w in zip(rows, words, strict=True):
        if learns(i):
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    return [(i, learns(i), len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n,
             sum(math.log10((k + 1) / (n + v + 1)) for k in [c[x] for x in w] + [ends])) for (i, _), w in zip(rows, words, strict=True)]


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g.score < 0 and math.isfinite(g.score)


def test_edges(make):
    rows = [(1, None), (2, ""), (None, "Null id words"), (4, "a A b"), (4, "a A b"), (5, "é" * 3000 + " x"), (6, "new unseen"), (7, "w " * 100_000)]
    docs = make([(*r, 1, "x", True) for r in rows], DOC)
    learns = lambda i: i is not None and i != 6
    out = score_texts(docs, F.col("id") != 6)
    assert out.columns == ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    _same(out.collect(), _brute(rows, learns))
    _same(score_texts(docs, F.lit(False)).collect(), _brute(rows, lambda i: False))
    assert score_texts(make([], DOC), F.lit(True)).count() == 0


def test_query_against_brute_force(spark, documents):
    rows = [(d["doc_id"], d["text"]) for d in documents]
    got = QUERIES["op1_lattice_score"](spark, SF).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = [(i, held(i), *x) for i, _, *x in _brute(rows, lambda i: not held(i))]
    _same(got, want)
    assert [f.dataType.simpleString() for f in QUERIES["op1_lattice_score"](spark, SF).schema][:7] == [
        "bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]


def test_vocabulary_probabilities_add_up():
    assert abs(sum(math.exp(s) for _, _, s in load_pieces()) - 1) < 1e-9
