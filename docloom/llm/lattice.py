"""Subword lattice likelihood: the pieces of an existing vocabulary, each with
its probability, weight all segmentations of a word; the forward recursion in
log space sums them, and a text's probability is the product over its words.

A word (lower-cased, after ``▁``) is drawn with probability
``(c + alpha * base) / (N + alpha)``: ``c`` of the ``N`` training tokens are
this word, ``base`` is the lattice marginal, and ``alpha`` the number of words
seen once (so that a new word gets the share that new words had).  A piece
sequence goes on with probability ``GO_ON`` (at first); characters outside the vocabulary
go by bytes.  The vocabulary's scores weight the lattices of the training
words once (expected piece counts, from forward and backward sums), and the
counts, with the scores as prior, give the piece probabilities that score; and
how often a word goes on.

Recursions run in numpy over all words of a length at once.

Defined results: null or empty text is its end token alone; with no training
rows N is 0 and the base alone scores; repeated rows count each; null ids are
training or held out by the crc32 of the empty text; only the id and the text
are read, so other columns may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import Block, bucketed, numbered, pack, plain_words, returned
from .pieces import MODEL_FILE, load_pieces

GO_ON = 0.75
#: Weight of the vocabulary's own scores against the expected counts.
PRIOR_COUNT = 32_000.0
#: Probability of the bytes beside the pieces, of the text's end beside the words.
BYTES, END = 1e-4, 1e-2
#: Words of one length that are worked on at once.
AT_ONCE = 20_000


class Trie:
    """Pieces by exact steps: (node, code point) to node, as sorted numbers."""

    def __init__(self, pieces: list[tuple[int, str, float]]):
        steps: dict[int, int] = {}
        self.piece = [-1]
        for row, (_, piece, _) in enumerate(pieces):
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(self.piece))
                if node == len(self.piece):
                    self.piece.append(-1)
            self.piece[node] = row
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(self.piece)
        self.longest = max(len(p) for _, p, _ in pieces)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((node >= 0) & (self.keys[at] == key), self.to[at], -1)


def _edges(chars: np.ndarray, trie: Trie) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of the pieces in words of one length (a row each)."""
    length = chars.shape[1]
    for start in range(length):
        rows, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for end in range(start + 1, min(length, start + trie.longest) + 1):
            node = trie.step(node, chars[rows, end - 1])
            rows, node = rows[node >= 0], node[node >= 0]
            if not len(rows):
                break
            piece = trie.piece[node]
            if (piece >= 0).any():
                yield start, end, rows[piece >= 0], piece[piece >= 0]


def _byte_cost(chars: np.ndarray, log_byte: float) -> np.ndarray:
    """Log-probability of a character written in bytes."""
    return (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)) * log_byte


def forward(chars: np.ndarray, trie: Trie, log_p: np.ndarray, log_byte: float, edges: list | None = None) -> np.ndarray:
    """Log of the sum over segmentations, for each prefix of each word."""
    n, length = chars.shape
    sums = np.full((n, length + 1), -np.inf)
    sums[:, 0] = 0
    by_start: dict[int, list] = {}
    for e in edges if edges is not None else _edges(chars, trie):
        by_start.setdefault(e[0], []).append(e)
    unit = _byte_cost(chars, log_byte)
    for start in range(length):
        sums[:, start + 1] = np.logaddexp(sums[:, start + 1], sums[:, start] + unit[:, start])
        for _, end, rows, piece in by_start.get(start, ()):
            sums[rows, end] = np.logaddexp(sums[rows, end], sums[rows, start] + log_p[piece])
    return sums


def backward(chars: np.ndarray, log_p: np.ndarray, log_byte: float, edges: list) -> np.ndarray:
    n, length = chars.shape
    sums = np.full((n, length + 1), -np.inf)
    sums[:, length] = 0
    by_start: dict[int, list] = {}
    for e in edges:
        by_start.setdefault(e[0], []).append(e)
    unit = _byte_cost(chars, log_byte)
    for start in range(length - 1, -1, -1):
        sums[:, start] = sums[:, start + 1] + unit[:, start]
        for _, end, rows, piece in by_start.get(start, ()):
            sums[rows, start] = np.logaddexp(sums[rows, start], sums[rows, end] + log_p[piece])
    return sums


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of some words of one length at a time, after ``▁``."""
    texts = pa.compute.binary_join_element_wise("▁", words, "")
    sizes = pa.compute.utf8_length(texts).to_numpy()
    order = np.argsort(sizes, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(some):
            size = int(sizes[some[0]])
            step = max(1, AT_ONCE // max(1, size // 16))
            for i in range(0, len(some), step):
                yield from _decoded(texts, some[i:i + step], size)


def _decoded(texts: pa.Array, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(at) and size:
        joined = "".join(texts.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(at), size)


class PieceModel:
    """Trie and log-probabilities (going on included); travels by broadcast,
    as large as the vocabulary."""

    def __init__(self, pieces: list[tuple[int, str, float]], counts: np.ndarray | None = None, go_on: float = GO_ON):
        self.trie, self.go_on = Trie(pieces), go_on
        p = np.exp(np.array([s for _, _, s in pieces]))
        if counts is not None:
            p = (counts + PRIOR_COUNT * p) / (counts.sum() + PRIOR_COUNT)
        # a word's first piece starts with the blank's sign, the others don't
        first = np.array([x.startswith("▁") for _, x, _ in pieces])
        p = p / np.where(first, p[first].sum(), p[~first].sum())
        self.log_p = np.log(p * (1 - BYTES)) + np.log(go_on)
        self.log_byte = float(np.log(BYTES / 256) + np.log(go_on))

    def log_marginal(self, words: pa.Array) -> np.ndarray:
        out = np.zeros(len(words))
        for at, chars in _by_length(words):
            out[at] = forward(chars, self.trie, self.log_p, self.log_byte)[:, -1] + np.log(1 - self.go_on) - np.log(self.go_on)
        return out

    def expected_counts(self, words: pa.Array, weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words' segmentations."""
        out = np.zeros(len(self.log_p))
        for at, chars in _by_length(words):
            edges = list(_edges(chars, self.trie))
            ahead, back = forward(chars, self.trie, self.log_p, self.log_byte, edges), backward(chars, self.log_p, self.log_byte, edges)
            total = ahead[:, -1]
            for start, end, rows, piece in edges:
                share = np.exp(ahead[rows, start] + self.log_p[piece] + back[rows, end] - total[rows])
                out += np.bincount(piece, share * weights[at[rows]], len(out))
        return out


def adapted(words: DataFrame, pieces: list[tuple[int, str, float]]) -> PieceModel:
    """Piece probabilities from the distinct training words (word, learnt)."""
    shared = words.sparkSession.sparkContext.broadcast(PieceModel(pieces))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces))
        for b in frames:
            total += shared.value.expected_counts(b.column(0), b.column(1).to_numpy().astype(float))
        some = np.flatnonzero(total > 0)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["piece", "count"])

    # a new word is drawn as a word type, not by how often it then occurs
    types = words.where("learnt > 0").select("word", F.lit(1).cast("long").alias("learnt"))
    found = (types.mapInArrow(run, "piece long, count double")
             .groupBy("piece").agg(F.sum("count").alias("count")).toArrow())  # as many rows as pieces at most
    counts = np.zeros(len(pieces))
    counts[found["piece"].to_numpy()] = found["count"].to_numpy()
    # as many pieces to a word as the training words are expected to have
    ends = types.count() if counts.sum() else 0
    return PieceModel(pieces, counts, float(np.clip(1 - ends / counts.sum(), 0.1, 0.95)) if ends else GO_ON)


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text",
                model_file: str = MODEL_FILE) -> DataFrame:
    """id_col, learn, n_tokens, n_known, train_tokens, base_score and score
    (log10 of the model's probability) of each row; it learns from the rows for
    which ``learn`` (over ``id``) holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("id", F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    packed = pack(rows, plain_words)
    words = numbered(packed)
    ends = packed.blocks.agg(F.sum(F.size(F.filter("learn", lambda x: x))).alias("n")).first().n or 0
    seen = words.where("learnt > 0").agg(F.sum("learnt").alias("n"), F.count(F.lit(1)).alias("v"),
                                         F.sum((F.col("learnt") == 1).cast("long")).alias("once")).first()
    n, v, alpha = (seen.n or 0) + ends, seen.v + (ends > 0), float(max(1, seen.once or 0))
    # a word's only blank is its first character: pieces with later ones match no word
    pieces = [x for x in load_pieces(model_file) if "▁" not in x[1][1:]]
    shared = docs.sparkSession.sparkContext.broadcast(adapted(words, pieces))

    def probabilities(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            c = b.column(3).to_numpy()
            base = shared.value.log_marginal(b.column(2)) + np.log1p(-END)
            log = np.where(c > 0, np.log(np.maximum(c, 1) + alpha * np.exp(base)), np.log(alpha) + base) - np.log(n + alpha)
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(log / np.log(10))], ["bucket", "word_id", "learnt", "log10"])

    valued = bucketed(words.select("bucket", "word_id", "word", "learnt")
                      .mapInArrow(probabilities, "bucket int, word_id long, learnt long, log10 double"), "bucket", packed.parts)
    kind = "c array<long>, p array<double>"
    pick = lambda t, at: {"c": t["learnt"].to_numpy()[at], "p": t["log10"].to_numpy()[at]}
    end_log = float(np.log10((ends + alpha * END) / (n + alpha)))
    end_base, denominator = float(np.log10(ends + 1)), float(np.log10(n + v + 1))

    def sums(block: Block, back: list[np.ndarray]) -> pa.Table:
        tokens = np.diff(block.splits)
        doc = np.repeat(np.arange(len(tokens)), tokens)
        count, logs = (x[block.place] for x in back)
        add = lambda x: np.bincount(doc, x, len(tokens))
        return pa.table({
            "id": block.ids, "learn": block.learn, "n_tokens": tokens.astype(np.int64) + 1,
            "n_known": (add(count > 0) + (ends > 0)).astype(np.int64), "train_tokens": np.full(len(tokens), n, np.int64),
            "base_score": add(np.log10(count + 1) - denominator) + end_base - denominator, "score": add(logs) + end_log})

    return (returned(packed, valued, kind, pick, sums, "id long, learn boolean, n_tokens long, n_known long, train_tokens long, "
                                                       "base_score double, score double")
            .withColumnRenamed("id", id_col))
