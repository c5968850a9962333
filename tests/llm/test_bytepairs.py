"""op11: pre-tokens, ids and bytes against the tokenizer library."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF
from pyspark.sql import functions as F

from docloom.llm import bytepairs, lexicon
from docloom.llm.queries import QUERIES

PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "中", "文", "1", "²", "½", "!", "…", " ", "　",
          "😀", "́", "S", "'ll", "<|endoftext|>", "\0", "​"]
LONG = ["中文字" * 4000, " " * 2000, "a" * 5000, "ab" * 40, "", "'", "x'", "'s", "don't 'tis we'll we'LL 'sa's", "  x", "\n x", "x \n ", "x y"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(n=1500):
    draw = random.Random(3)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(n)] + LONG


def test_cuts_are_the_matches_of_the_pattern():
    import public_tokenizers
    import regex
    texts, classes = some_texts(), bytepairs.character_classes()
    got = [[s.word(i).decode() for i in range(s.splits[r], s.splits[r + 1])] for s in bytepairs.pattern_words(pa.array(texts), classes) for r in range(s.rows)]
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_words_are_encoded_as_by_the_library(library):
    ranks = bytepairs.load_ranks()
    words = sorted({w for t in some_texts() for w in t.split()} | {"x" * n for n in (63, 64, 65, 66, 500)})
    sizes, ids = bytepairs.encode_words(pa.array(words), ranks)
    ends = np.cumsum(sizes)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes, strict=True)] == [library.encode_single_token(w) if w is None else library._encode_single_piece(w)
                                                                              for w in words]


def test_texts_there_and_back(spark, make, library):
    rows = [(i, t, "other", 0) for i, t in enumerate(some_texts(300))] + [(7, "again", "x", 1), (7, "again", "x", 1), (None, "no id", "x", 2), (None, None, None, None)]
    docs = make(rows, "doc_id long, text string, ids string, block int")
    back = bytepairs.decode(bytepairs.encode(docs)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.bytes)) for r in back)
    assert got == sorted((i is None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert bytepairs.decode(bytepairs.encode(docs.limit(0))).count() == 0


def test_the_query_equals_the_library(spark, documents, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    want = {}
    for d in documents:
        ids = library.encode_ordinary(d["text"] or "")
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
    assert got == want


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [72, 105]), (2, []), (3, None)], "k int, ids array<int>")
    assert [r.bytes is None for r in bytepairs.decode(rows).orderBy("k").collect()] == [False, False, True]


def test_more_hash_buckets_than_a_table_may_have(spark, make, library, monkeypatch):
    monkeypatch.setattr(lexicon, "BUCKET_ROWS", 1)
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "16")
    try:
        rows = [(i, t) for i, t in enumerate(some_texts(200))]
        got = {r.doc_id: list(r.ids) for r in bytepairs.encode(make(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_a_block_holds_a_bounded_number_of_pre_tokens(spark):
    from docloom.llm.bytepairs import BLOCK_WORDS, character_classes, pattern_words
    from docloom.llm.lexicon import pack
    classes = character_classes()
    docs = spark.range(22).coalesce(1).select("id", F.lit(True).alias("learn"), F.repeat(F.lit("ab "), 100_000).alias("text"))
    blocks = pack(docs, lambda texts: pattern_words(texts, classes), BLOCK_WORDS, counts=False).blocks
    held = [r.n for r in blocks.select(F.expr("aggregate(sizes, 0, (a, x) -> a + x)").alias("n")).collect()]
    assert len(held) > 1 and max(held) <= 1_200_000 and sum(held) >= 2_200_000
