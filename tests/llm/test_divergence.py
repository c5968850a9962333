"""op13: pointer sort and audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plainly(rows, least, smooth=5, scale=10**9, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOW))
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(counter, kept=kept):
            total = sum(counter[t] for t in kept)
            return {t: 1 + scale * (counter[t] + smooth) // (total + smooth * len(kept)) for t in kept}

        q = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, items in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


def some_rows(n, seed=5):
    draw = random.Random(seed)
    words = ["a", "b", "the", "THE", "word", "words", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefgh" * 3, "é", "中文", "zé", "x y", "12a3", "Ünder"]
    words += ["w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)]
    return [(draw.choice(["en", "en", "de", None, ""]), draw.choice(["hot"] * 5 + ["s1", "s2", "é", None, "quiet"]),
             None if draw.random() < 0.05 else " ".join(draw.choices(words, k=draw.randint(0, 30)))) for _ in range(n)]


def got(docs, **how):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.audit(docs, **how).collect())


@pytest.mark.parametrize("segment", [2, 16, 1 << 15])
def test_pointer_sort(segment):
    draw = np.random.default_rng(2)
    words = [bytes(draw.choice(list(b"ab\xc3z"), draw.integers(1, 40)).tolist()) for _ in range(3000)] + [b"a" * 8, b"a" * 16, b"a" * 9] * 200
    text = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    order, new = divergence.pointer_sort(text, starts, lengths, segment)
    want = sorted(range(len(words)), key=lambda i: words[i])  # stable
    assert order.tolist() == want
    assert new.tolist() == [i == 0 or words[want[i]] != words[want[i - 1]] for i in range(len(want))]


@pytest.mark.parametrize("least", [1, 30, 10_000])
def test_audit_equals_plain_python(make, least):
    rows = some_rows(600)
    docs = make([(*r, "x", 0) for r in rows], "lang string, source string, text string, term string, n int", 7)
    assert got(docs, least=least) == plainly(rows, least)


def test_many_sources_shards_and_small_pieces(make):
    rows = some_rows(400, 9) + [("en", f"more{i % 9}", "the word " * (i % 4)) for i in range(90)]
    assert got(make(rows, "lang string, source string, text string"), least=3, block=3, cells=40, matrix=5) == plainly(rows, 3)


def test_no_rows_one_source_and_long_terms(make):
    schema = "lang string, source string, text string"
    assert got(make([], schema)) == []
    rows = [("en", "only", "a b " + "c" * 100_000)] * 40 + [("zz", "one", None), ("zz", "two", "")]
    assert got(make(rows, schema)) == plainly(rows, 30)
    assert [r[:5] for r in got(make(rows, schema)) if r[0] == "zz"] == [("zz", "one", "pair", "two", 0), ("zz", "two", "pair", "one", 0)]
