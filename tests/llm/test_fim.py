"""op12: fill-in-middle against plain Python, and round trips."""

import hashlib
import re

import pytest

from docloom.llm.fim import fill_in_middle, restore

MARKS = ("<P>", "<S>", "<M>")


def plainly(doc_id, text, seed, rate, spm, marks):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, text
    x, y, z = marks
    return (n, "spm", p, m, s, y + s + x + p + z + m) if h[3] % 100 < spm else (n, "psm", p, m, s, x + p + y + s + z + m)


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\nb\n", "\na", "ü\nß\n中文\n😀", "has <P> in it\nx", "<M>", "<\nS>\n<", "<P\n>", "tail <", "\r\n\r\n",
         "x\n" * 5000, "long line " * 30_000, "same\nsame\n", "same\nsame\n", "a b\x0bc\nd"]
ROWS = [(i, t, "psm", "o") for i, t in enumerate(TEXTS * 6)] + [(3, "twice\nthe id", "x", "y"), (3, "twice\nthe id", "x", "y"), (None, "no\nid\n", "x", "y")]


@pytest.mark.parametrize(("seed", "rate", "spm", "marks"), [(7, 100, 50, MARKS), (11, 60, 0, ("<P>", "[S]", "§")), (7, 0, 50, MARKS)])
def test_equals_plain_python_and_comes_back(make, seed, rate, spm, marks):
    docs = make(ROWS, "doc_id long, text string, form string, output string")
    out = restore(fill_in_middle(docs, seed=seed, rate=rate, spm=spm, marks=marks), marks=marks).collect()
    key = lambda r: repr(r)
    got = sorted([(r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in out], key=key)
    assert got == sorted([(i, *plainly(i, t, seed, rate, spm, marks)) for i, t, *_ in ROWS], key=key)
    assert sorted(r.restored for r in out) == sorted(t or "" for _, t, *_ in ROWS)


def test_no_rows(make):
    docs = make([], "doc_id long, text string")
    assert restore(fill_in_middle(docs)).collect() == []


def test_same_whatever_the_partitions(make):
    docs = make(ROWS[:60], "doc_id long, text string, form string, output string")
    one, many = (sorted(map(repr, fill_in_middle(docs.repartition(n)).collect())) for n in (1, 13))
    assert one == many
