import random
import re

import pyarrow as pa

from docloom.llm.decontaminate import benchmark_windows, clean_documents, contaminated, cut_spans, find_hits
from docloom.llm.words import ALNUM, NON_SPACE, scan, window_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, row string, items string, n_hit long"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, n):
    w, hit, ids = words(text), set(), set()
    for item_id, t in items:
        x = words(t)
        k = min(n, len(x))
        grams = {tuple(x[i:i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                ids.add(item_id)
    return len(w), len(hit), sorted(ids)


def test_scan_finds_words_and_equal_hashes_for_equal_words():
    texts = ["Ab  cd\néÉ x", None, "", "cd ab", "퟿\t " * 3]
    seen = {}
    for s in scan(pa.array(texts), NON_SPACE, slice_bytes=8):
        for r in range(s.rows):
            got = [s.word(i).decode() for i in range(s.splits[r], s.splits[r + 1])]
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[s.first + r] or "")
            assert got == re.findall(r"[^\x20\x09-\x0D]+", low)
            for i, w in zip(range(s.splits[r], s.splits[r + 1]), got, strict=True):
                assert seen.setdefault(w, s.hashes[i]) == s.hashes[i]
    assert len(set(seen.values())) == len(seen)
    (s,) = scan(pa.array(["a b c", "a b", "b c a b"]), ALNUM)
    at, h = window_hashes(s, 2)
    assert at.tolist() == [0, 1, 3, 5, 6, 7] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_hits_equal_brute_force_either_way(make):
    rng = random.Random(2)
    vocab = ["Aa", "b", "c1", "ü", "dd", "e-f"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 5, 9]))) for i in range(12)] + [(3, "b b b b"), (7, None), (10, "x y")]
    docs = [(i, text(rng.randint(0, 40)), "r", "i", 5) for i in range(60)]
    docs += [(60, None, None, None, None), (61, "", "", "", 0), (None, items[4][1], "r", "i", 1), (5, docs[5][1], "r", "i", 5),
             (62, "b " * 5000, "r", "i", 0)]
    bench = make(items, "item_id int, text string")
    windows = benchmark_windows(bench, 4)
    for most in (10**6, 0):
        got = find_hits(make(docs, DOC), windows, max_broadcast=most).collect()
        assert len(got) == len(docs)
        for r in got:
            n, hit, ids = brute(r["row"].text, [(str(a), b) for a, b in items], 4)
            assert (r.n_words, r.n_hit, r["items"]) == (n, hit, ids)
            assert sum(len(words(r["row"].text[s.start:s.end])) for s in r.spans) == hit


def test_spans_documents_and_edges(make):
    bench = make([("q", "one two three four five")], "item_id string, text string")
    docs = make([(1, "é x, ONE two three four five! y", "r", "i", 1), (2, "clean text", "r", "i", 2), (3, None, "r", "i", 3),
                 (4, "z " * 200 + "one two three four five", "r", "i", 3)], DOC)
    hits = find_hits(docs, benchmark_windows(bench))
    cut = {r["row"].doc_id: (r.clean_text, r.c) for r in cut_spans(hits).withColumn("c", contaminated()).collect()}
    assert cut[1] == ("é x, ! y", True) and cut[2] == ("clean text", False) and cut[3] == (None, False)
    assert cut[4][1] is False and cut[4][0] == "z " * 200
    kept = clean_documents(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    none = make([], "item_id string, text string")
    assert clean_documents(docs, none).count() == 4 and clean_documents(make([], DOC), bench).count() == 0
