import functools
import hashlib
import random
import re
import time

import corpus_pipeline
from conftest_llm import SF
from pyspark.sql import functions as F

from docloom.llm.lexicon import run_words
from docloom.llm.pieces import MODEL_FILE, UNKNOWN_PENALTY, byte_ids, load_pieces, piece_table
from docloom.llm.sentencepiece import decode, encode, lattice, long_viterbi, viterbi

DOC = "doc_id long, text string, ids string, word_id long, block long"
SWAP = str.maketrans(" ▁", "▁ ")


def plain_viterbi():
    table = {p: (s, i) for i, p, s in load_pieces()}
    unknown, longest, bytes_of = min(s for s, _ in table.values()) - UNKNOWN_PENALTY, max(map(len, table)), byte_ids()
    known = {}

    def ids(word):
        if word not in known:
            w = word.translate(SWAP)
            best = [(0.0, [])]
            for end in range(1, len(w) + 1):
                top = None
                for start in range(max(0, end - longest), end):
                    part = w[start:end]
                    options = [(table[part][0], [table[part][1]])] if part in table else []
                    if end - start == 1:
                        options.append((unknown, [bytes_of[b] for b in part.translate(SWAP).encode()]))
                    for s, x in options:
                        if top is None or best[start][0] + s > top[0]:
                            top = (best[start][0] + s, best[start][1] + x)
                best.append(top)
            known[word] = best[-1][1]
        return known[word]
    return lambda text: [i for w in re.findall(r" [^ \n]*|\n|[^ \n]+", " " + text) for i in ids(w)] if text else []


def test_ids_equal_plain_viterbi_and_decode_gives_the_text_back(make):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "The quick brown fox.\n\n  Jumps  over"), (6, "tab\tx\r\n ▁literal▁ ▁▁"), (7, "日本語 😀 é é"),
            (8, "x" * 600), (None, "null id"), (5, "again"), (5, "again"), (9, "<0x41> <unk> <s>"), (10, "\u0000 ﷐"), (11, "word, " * 20_000),
            (12, "Antidisestablishmentarianism internationalization " * 3)]
    docs = make([(*r, "x", 1, 2) for r in rows], DOC)
    encoded = encode(docs)
    assert encoded.columns == ["doc_id", "ids"]
    plain = plain_viterbi()
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encoded.collect()))
    assert got == sorted((i or 0, plain(t or "")) for i, t in rows)
    texts = sorted((r.doc_id or 0, r.text) for r in decode(encoded).collect())
    assert texts == sorted((i or 0, t or "") for i, t in rows)
    assert encode(make([], DOC)).count() == 0 and decode(make([(1, None)], "doc_id long, ids array<int>")).first().text is None


def test_whole_documents_come_back(spark, documents):
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in documents], "doc_id long, text string")
    encoded = encode(docs)
    texts = {r.doc_id: r.text for r in decode(encoded).collect()}
    assert texts == {d["doc_id"]: d["text"] or "" for d in documents}
    plain = plain_viterbi()
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert all(ids[d["doc_id"]] == plain(d["text"] or "") for d in documents)


@functools.cache
def vocabulary():
    table = {p: (s, i) for i, p, s in load_pieces()}
    return table, min(s for s, _ in table.values()) - UNKNOWN_PENALTY, max(map(len, table)), byte_ids()


def uncut_viterbi(text, lead=" "):
    """Ids of the best path over the whole text, no words."""
    table, unknown, longest, bytes_of = vocabulary()
    w = (lead + text).translate(SWAP)
    best = [(0.0, None, [])]
    for end in range(1, len(w) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            part = w[start:end]
            s, ids = table[part][0] if part in table else unknown, [table[part][1]] if part in table else [bytes_of[b] for b in part.translate(SWAP).encode()]
            if (part in table or end - start == 1) and (top is None or best[start][0] + s > top[0]):
                top = (best[start][0] + s, start, ids)
        best.append(top)
    out, at = [], len(w)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for x in reversed(out) for i in x]


def by_runs(text):
    """The best paths of a text's words; paths of equal score differ by rounding where words are summed up."""
    return [i for w in re.findall(r" +[^ \n]*|\n|[^ \n]+", " " + text) for i in uncut_viterbi(w, "")] if text else []


def test_registered_form_on_whole_documents(spark, documents):
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in documents[:60]], "doc_id long, text string")
    encoded = encode(docs, words=run_words)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {d["doc_id"]: by_runs(d["text"]) for d in documents[:60]}
    score = {i: s for i, _, s in load_pieces()}
    for d in documents[:10]:  # as good as the best path over the whole text
        cost = [sum(score.get(i, 0.0) for i in x) for x in (got[d["doc_id"]], uncut_viterbi(d["text"] or ""))]
        assert abs(cost[0] - cost[1]) < 1e-6 or any(i not in score for i in got[d["doc_id"]])
    assert {r.doc_id: r.text for r in decode(encoded).collect()} == {d["doc_id"]: d["text"] or "" for d in documents[:60]}


def test_the_query_decodes_every_text(spark, documents):
    from docloom.llm.queries_sentencepiece import op7_sentencepiece
    got = {r.doc_id: (r.n_pieces, r.decoded_sha256) for r in op7_sentencepiece(spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        text = d["text"] or ""
        assert got[d["doc_id"]][1] == hashlib.sha256(text.encode()).hexdigest()
    assert all(got[d["doc_id"]][0] == len(by_runs(d["text"] or "")) for d in documents[:40])


def test_decoding_of_any_ids(make):
    blank, letters = 28705, byte_ids()
    rows = [(1, None), (2, []), (3, [blank]), (4, [blank, letters[0xFF], letters[65]]), (5, [blank, *[letters[b] for b in "é".encode()], blank])]
    got = {r.doc_id: r.text for r in decode(make(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {1: None, 2: "", 3: "", 4: "\ufffdA", 5: "é "}


def test_long_words_are_linear(make):
    rng = random.Random(3)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(100_000)), " " * 20_000 + "x",
             "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/=") for _ in range(3000)), "a" * 2050, "日本" * 700 + "é" * 500]
    docs = make(list(enumerate(texts)), "doc_id long, text string")
    begun = time.time()
    encoded = encode(docs, words=run_words)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert time.time() - begun < 120  # the former fold had not ended with 4,000 characters after 45 s
    assert [got[i] == by_runs(t) for i, t in enumerate(texts)] == [True] * len(texts)
    assert {r.doc_id: r.text for r in decode(encoded).collect()} == dict(enumerate(texts))


def test_both_folds_agree(spark):
    words = ["x" * 70, "internationalization", "日本語", "a", " " * 40 + "b", "▁▁", "-=" * 30]
    rows = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "bucket int, word_id long, word string")
    table = load_pieces()
    longest = max(len(p) for _, p, _ in table)
    edges = lattice(rows, piece_table(spark, table), longest, -30.0)
    for r in edges.select(viterbi(F.col("edges")).alias("a"), long_viterbi(F.col("edges"), longest).alias("b")).collect():
        assert r.a == r.b


def test_every_normal_piece_is_kept():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = load_pieces()
    assert [i for i, _, _ in pieces] == normal
    scores = [s for _, _, s in pieces]
    assert scores == sorted(scores, reverse=True)  # by rank, the blanks too


def test_pieces_of_blanks_are_used(make):
    texts = [" ", "x ", "a  b", "def f():\n    return 1\n        # 3 years", "  x", "   \n\n  y", "3 years 5 日本", "a" + " " * 17 + "b", "▁ ▁▁", "", "end   "]
    stage = dict(corpus_pipeline.STAGES)["pieces"]
    docs = make(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in stage(docs.sparkSession, docs, "").collect()}
    assert got == {i: uncut_viterbi(t) if t else [] for i, t in enumerate(texts)}
    used = {i for x in got.values() for i in x}
    assert {28705, 259, 2287, 359} <= used and byte_ids()[32] not in used
    encoded = stage(docs.sparkSession, docs, "")
    assert {r.doc_id: r.text for r in decode(encoded).collect()} == dict(enumerate(texts))
