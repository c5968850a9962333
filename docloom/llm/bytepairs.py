"""Byte-level BPE encoding and decoding over a shuffle of distinct pre-tokens.

Texts are cut into pre-tokens (``pattern_words``), which are packed with their
positions into blocks (see ``lexicon``): each block holds its distinct pre-tokens
once, and in place of the texts numbers of them.  The distinct pre-tokens are
shuffled by hash; those of a bucket are encoded once for all blocks; each block
gets its own back, and puts the ids together by position.  What is shuffled are
distinct pre-tokens of a block, so a frequent one is no hot key.  Decoding joins
the ids with the token-byte table, which is broadcast: its size is that of the
vocabulary.

* **Cutting** needs no regular expression: with one class for each character
  (letter, number, white space, other; taken from the tokenizer library's own
  tables), the pattern's matches follow from the runs of a class.  A run of white
  space gives its last character to what follows if that is a blank, else the
  last character stands alone; an apostrophe that is a run of its own and
  follows no blank takes the contraction's letters.
* **Encoding** takes pre-tokens that are tokens as they are.  The others start
  as bytes; each round joins, in all pre-tokens at once, the leftmost pair of
  least rank.  Those of more than ``LONG`` bytes go by a heap, in time
  n log n.

Defined results: null and empty text have no ids and decode to no bytes; long
texts and pre-tokens are taken whole; repeated rows and null ids keep rows of
their own; only id and text are read, so other columns may have any name; an
empty table gives an empty result; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .lexicon import BLOCK_COLUMNS, Block, _as_bytes, _from_bytes, _gathered, pack, read_blocks
from .words import _BASE, SAME, Slice, _runs, joined

#: Pre-tokens of a block at most (but for a longer text): they are shorter than words.
BLOCK_WORDS = 1_200_000
#: Pre-tokens of more bytes are encoded by a heap.
LONG = 64
#: Classes of characters.
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: What an apostrophe takes along.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_BITS = 20


def default_ranks() -> str:
    """The public vocabulary's file; its path is a parameter everywhere."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------- cutting

def character_classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library tells them apart."""
    import tiktoken
    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        found = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        # what a pattern doesn't match is left out
        out[[ord(c) for c in bytes(found.encode_ordinary(every)).decode()]] = kind
    return out


def _classes_of(text: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each byte: that of its character."""
    out = classes[:256][text].copy()
    lead = np.flatnonzero(text >= 0xC0)
    if len(lead):
        first = text[lead].astype(np.int64)
        at = lambda k: text[np.minimum(lead + k, len(text) - 1)].astype(np.int64) & 63
        point = np.where(first < 0xE0, (first & 31) << 6 | at(1),
                         np.where(first < 0xF0, (first & 15) << 12 | at(1) << 6 | at(2), (first & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        kind = classes[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            has = first >= (0, 0xC0, 0xE0, 0xF0)[k]
            out[np.minimum(lead[has] + k, len(text) - 1)] = kind[has]
    return out


def pattern_words(texts: pa.Array, classes: np.ndarray) -> Iterator[Slice]:
    """The pattern's matches: contractions, runs of letters, numbers or other
    characters with a blank before them, and runs of white space."""
    for row, text, bounds in joined(texts, SAME):
        stops = bounds[1:] - 1
        kind = _classes_of(text, classes)
        kind[stops] = END
        edge = np.ones(len(text), bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[stops] = True
        run = np.flatnonzero(edge)
        kinds, ends = kind[run], np.append(run[1:], len(text))
        after = np.append(kinds[1:], END)
        starts = np.zeros(len(text) + 1, bool)
        starts[run] = True
        # white space before other characters: its last character
        space = np.flatnonzero((kinds == SPACE) & (after != END))
        last = ends[space] - 1
        for _ in range(3):
            last -= (text[last] & 0xC0) == 0x80
        starts[last] = True
        blank = text[last] == 32
        starts[ends[space[blank]]] = False
        # contractions: an apostrophe alone that starts a match
        mark = np.flatnonzero((kinds == OTHER) & (ends - run == 1) & (text[run] == 39) & (after == LETTER))
        mark = mark[starts[run[mark]]]
        if len(mark):
            begin = run[mark] + 1
            size = np.zeros(len(mark), np.int64)
            padded = np.concatenate([text, np.zeros(2, np.uint8)])
            for letters in CONTRACTIONS:
                same = np.ones(len(mark), bool)
                for k, c in enumerate(letters):
                    same &= padded[begin + k] == c
                size[same & (size == 0)] = len(letters)
            begin, stop, size = begin[size > 0], ends[mark + 1][size > 0], size[size > 0]
            starts[begin] = False
            on = begin + size < stop
            starts[(begin + size)[on]] = True
        starts[stops] = True
        at = np.flatnonzero(starts[:-1])
        word = kind[at] != END
        first, end = at[word], np.append(at[1:], len(text))[word]
        yield Slice(row, len(bounds) - 1, text, first, end, np.searchsorted(first, bounds),
                    _runs(text.astype(np.uint64) + np.uint64(1), first, end, _BASE[0]), bounds[:-1])


# ---------------------------------------------------------------- the vocabulary

@dataclass
class Ranks:
    """``tokens`` by rank; ``pairs`` (sorted: left << 20 | right) of tokens that
    join, and what they join to; ``single``: the rank of each byte."""
    tokens: pa.Array
    pairs: np.ndarray
    joined: np.ndarray
    single: np.ndarray

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs join to; a rank beyond all if they don't."""
        key = left << _BITS | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], 1 << _BITS)


def load_ranks(path: str | None = None) -> Ranks:
    with open(path or default_ranks(), "rb") as f:
        rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, filter(bytes.strip, f))}
    if len(rank) >= 1 << _BITS or sorted(rank.values()) != list(range(len(rank))):
        raise ValueError("ranks must be consecutive, and fewer than 2**20")
    missing = [b for b in range(256) if bytes([b]) not in rank]
    if missing:
        raise ValueError(f"bytes without a rank: {missing}")
    split = [(rank[t[:i]] << _BITS | rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
    pairs, to = np.array(sorted(split), np.int64).reshape(-1, 2).T
    tokens = sorted(rank, key=rank.__getitem__)
    return Ranks(pa.array(tokens, pa.large_binary()), pairs.copy(), to.copy(), np.array([rank[bytes([b])] for b in range(256)]))


# ---------------------------------------------------------------- encoding distinct words

def _by_heap(word: bytes, ranks: Ranks, known: dict) -> list[int]:
    """The ids of a long word: the least pair (the leftmost of equals) joins
    until none does."""
    parts = ranks.single[np.frombuffer(word, np.uint8)].tolist()
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    first = np.array(parts)
    heap = [(r, i) for i, r in enumerate(ranks.lookup(first[:-1], first[1:]).tolist()) if r < 1 << _BITS]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or known.get(parts[i] << _BITS | parts[j]) != r:
            continue  # one of the two has joined another
        parts[i], parts[j] = r, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (new := known.get(parts[a] << _BITS | parts[b])) is not None:
                heapq.heappush(heap, (new, a))
    return [p for p in parts if p >= 0]


def _by_rounds(letters: np.ndarray, sizes: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids) of words given by their bytes."""
    none = 1 << _BITS
    parts, word = ranks.single[letters], np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes) - 1

    def pair_ranks(parts: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(at), none)
        inner = ~ends[at]
        out[inner] = ranks.lookup(parts[at[inner]], parts[at[inner] + 1])
        return out

    ends = np.zeros(len(parts), bool)
    ends[last] = True
    rank = pair_ranks(parts, np.arange(len(parts)), ends)
    done_word, done_parts = [], []
    while len(parts):
        starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
        many = np.diff(np.append(starts, len(parts)))
        least = np.minimum.reduceat(rank, starts)
        still = np.repeat(least < none, many)
        if not still.all():  # words in which nothing joins any more
            done_word.append(word[~still])
            done_parts.append(parts[~still])
            parts, word, rank, ends = parts[still], word[still], rank[still], ends[still]
            many, least = many[least < none], least[least < none]
            if not len(parts):
                break
        # the leftmost pair of least rank in each word
        hit = np.flatnonzero(rank == np.repeat(least, many))
        at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
        parts[at] = rank[at]
        ends[at] = ends[at + 1]
        keep = np.ones(len(parts), bool)
        keep[at + 1] = False
        parts, word, rank, ends = parts[keep], word[keep], rank[keep], ends[keep]
        at = at - np.arange(len(at))  # each word lost one part before the next word's
        rank[at] = pair_ranks(parts, at, ends)
        left = at[(at > 0) & ~ends[at - 1]] - 1
        rank[left] = pair_ranks(parts, left, ends)
    word = np.concatenate([np.zeros(0, np.int64), *done_word])
    parts = np.concatenate([np.zeros(0, np.int64), *done_parts])
    order = np.argsort(word, kind="stable")
    return np.bincount(word, minlength=len(sizes)), parts[order]


def encode_words(words: pa.Array, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids): the ids of each word, one after the other."""
    words = words.cast(pa.large_binary())
    whole = pc.index_in(words, value_set=ranks.tokens).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    short, long = np.flatnonzero((whole < 0) & (lengths <= LONG)), np.flatnonzero((whole < 0) & (lengths > LONG))
    sizes = np.ones(len(words), np.int64)
    some = words.take(pa.array(short))
    letters = np.frombuffer(b"".join(some.to_pylist()), np.uint8)
    sizes[short], ids = _by_rounds(letters, lengths[short], ranks) if len(short) else (0, whole[:0])
    known = dict(zip(ranks.pairs.tolist(), ranks.joined.tolist(), strict=True)) if len(long) else {}
    spelled = [_by_heap(words[i].as_py(), ranks, known) for i in long.tolist()]
    sizes[long] = [len(x) for x in spelled]
    out = np.repeat(whole, sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    is_short = np.zeros(len(words), bool)
    is_short[short] = True
    out[is_short[of]] = ids
    begins = np.cumsum(sizes) - sizes
    for i, x in zip(long.tolist(), spelled, strict=True):
        out[begins[i]:begins[i] + len(x)] = x
    return sizes, out


# ---------------------------------------------------------------- encoding and decoding texts

#: Tokens whose ids are put together at once.
_AT_ONCE = 200_000


def _rows(block: Block, sizes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, ids) of each text of a block, from the ids of its pre-tokens."""
    begins = np.cumsum(sizes) - sizes
    first, last = 0, len(block.splits) - 1
    while first < last:
        stop = int(np.searchsorted(block.splits, block.splits[first] + _AT_ONCE, "right")) - 1
        stop = min(last, max(first + 1, stop))
        at = block.place[block.splits[first]:block.splits[stop]]
        cuts = np.concatenate([[0], np.cumsum(sizes[at])])
        out = values[np.arange(cuts[-1]) - np.repeat(cuts[:-1] - begins[at], sizes[at])]
        lists = pa.ListArray.from_arrays(pa.array(cuts[block.splits[first:stop + 1] - block.splits[first]].astype(np.int32)),
                                         pa.array(out.astype(np.int32)))
        yield pa.record_batch([block.ids.slice(first, stop - first), lists], ["id", "ids"])
        first = stop


def shared_ranks(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary for all tasks: as large as its file, whatever the texts are."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           also: dict[str, Callable[[pa.Array], pa.Array]] | None = None) -> DataFrame:
    """id_col and ids (of the whole text) of each row, by the ranks of ``path``;
    ``also``: further columns of bytes, by functions of lists of ids such as
    ``token_bytes`` and ``packed_ids``, made where the ids are put together, so
    that they take no second way through Python."""
    also = also or {}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("learn"), F.col(text).cast("string").alias("text"))
    ranks = shared_ranks(docs.sparkSession, path)
    classes = docs.sparkSession.sparkContext.broadcast(character_classes())
    packed = pack(rows, lambda texts: pattern_words(texts, classes.value), BLOCK_WORDS, counts=False)
    kind = np.dtype(np.uint16 if len(ranks.value.tokens) <= 1 << 16 else np.uint32)

    def once(key: tuple, bucket: pa.Table) -> pa.Table:
        """The bucket's words encoded, and each block's own sent back."""
        is_block = bucket["block"].is_valid().to_numpy()
        words = bucket.filter(pa.array(~is_block))["words"].combine_chunks().flatten()
        sizes, ids = encode_words(words, ranks.value)
        begins = np.cumsum(sizes) - sizes
        theirs = bucket.filter(pa.array(is_block))
        many, place = _gathered(theirs["places"])
        widths, sent = [], []
        for own in np.split(place.to_numpy(), np.cumsum(many)[:-1]):
            size = sizes[own]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begins[own], size)
            widths.append(_as_bytes(size).tobytes())
            sent.append(ids[at].astype(kind).tobytes())
        return pa.table({"block": theirs["block"], "bucket": theirs["bucket"], "widths": pa.array(widths, pa.binary()), "sent": pa.array(sent, pa.binary())})

    def finish(key: tuple, block: pa.Table, back: pa.Table) -> pa.Table:
        back = back.take(pa.array(np.argsort(back["bucket"].to_numpy())))
        sizes = _from_bytes(np.frombuffer(b"".join(back["widths"].to_pylist()), np.uint8))
        values = np.frombuffer(b"".join(back["sent"].to_pylist()), kind)
        parts = [pa.record_batch([*b.columns, *[made(b.column(1)) for made in also.values()]], ["id", "ids", *also])
                 for one in read_blocks(block.to_batches()) for b in _rows(one, sizes, values)]
        return pa.Table.from_batches(parts, pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), *[(c, pa.binary()) for c in also]]))

    schema = ", ".join(["id long, ids array<int>", *[f"`{c}` binary" for c in also]])
    back = packed.table.select("bucket", "block", "places", "words").groupBy("bucket").applyInArrow(once, "block long, bucket int, widths binary, sent binary")
    return (packed.blocks.select(*BLOCK_COLUMNS).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)
            .withColumnRenamed("id", id_col))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of lists; a null one is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(zero_copy_only=False)


def _binary(lists: pa.Array, ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), data])
    return pc.if_else(lists.is_valid(), made, None).cast(pa.binary())


def token_bytes(ranks: Broadcast) -> Callable[[pa.Array], pa.Array]:
    """A function of lists of ids: the bytes they stand for, by a join with the
    token-byte table.  A null list gives null."""
    def decoded(lists: pa.Array) -> pa.Array:
        cuts, ids = _flat(lists)
        taken = ranks.value.tokens.take(pa.array(ids))  # the tokens' bytes, one after the other
        _, offsets, data = taken.buffers()
        return _binary(lists, np.frombuffer(offsets, np.int64)[taken.offset + cuts], data)
    return decoded


def packed_ids(lists: pa.Array) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers, one after the other."""
    cuts, ids = _flat(lists)
    return _binary(lists, cuts * 4, pa.py_buffer(ids.astype("<u4")))


def decode(encoded: DataFrame, ids: str = "ids", name: str = "bytes", path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    decoded = token_bytes(shared_ranks(encoded.sparkSession, path))

    @F.arrow_udf(BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        return decoded(lists)

    return encoded.withColumn(name, run(encoded[ids]))
