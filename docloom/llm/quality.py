"""Quality from weak labels: overlapping heuristic labellers vote good, bad or
abstain on every text; expectation-maximisation over the counts of their vote
patterns estimates each labeller's accuracy; the posterior labels of a bounded
sample train a hashed linear scorer, which scores every whole text.

Only vote patterns (at most ``3 ** len(LABELLERS)``) and the sample
(``SAMPLE`` rows, those with the smallest hash of their id) reach the driver.

Defined results: a text without words (null, empty, blanks) gets no votes, and
is scored by its features alone (none: the bias); with no document, or none
with a vote, the model is neutral (score 0.5, accepted).  Repeated rows count
each; null ids are scored, and take part like others; other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_soft, gather, sigmoid
from .words import NON_SPACE, SAME, Slice, batches, mix, scan

BITS = 12
SAMPLE = 20_000
ROUNDS = 50
#: Words from which shares of words mean anything.
LEAST_WORDS = 20
GOOD, ABSTAIN, BAD = 1, 0, -1
#: What is assumed of every labeller: it calls a good text bad at most so
#: often, and a bad one within these bounds (each knows only some faults).
FALSE_ALARMS, CATCHES = 0.01, (0.1, 0.6)

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_PLAIN = np.isin(_B, list(b".,;:'\"-?()/@+")) | ((_B >= 48) & (_B <= 57))
_ODD = ~_LETTER & ~_PLAIN & NON_SPACE
# class of a byte in word shapes: lower or non-ASCII, upper, digit, else itself
_SHAPE = np.where(_UPPER, 65, np.where(_LETTER, 97, np.where((_B >= 48) & (_B <= 57), 48, _B))).astype(np.uint64)


@dataclass(frozen=True)
class Labeller:
    """Votes bad from ``bad`` on and good up to ``good`` (of a statistic where
    more is worse)."""
    name: str
    good: float
    bad: float


#: The statistics of ``statistics()``, in its order.
LABELLERS = (Labeller("upper share of letters", 0.25, 0.5),
             Labeller("odd symbols per byte", 0.02, 0.06),
             Labeller("words that repeat the one before", 0.05, 0.25),
             Labeller("words without a letter", 0.1, 0.25),
             Labeller("words that end in an odd symbol", 0.05, 0.3),
             Labeller("share of the commonest word", 0.25, 0.55),
             Labeller("repeated words beyond those of usual text", 0.6, 0.9),
             Labeller("words that repeat the three before", 0.02, 0.15))


def _per_row(s: Slice, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    return np.add.reduceat(flags.astype(np.int64), s.row_at)


def statistics(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """A column for each labeller, and the number of words, by row."""
    n = np.diff(s.splits)
    words = np.maximum(n, 1)
    rows = s.row_of_words()

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows, flags, s.rows) / words

    again = np.zeros(len(rows), bool)
    again[1:] = (s.hashes[1:] == s.hashes[:-1]) & (rows[1:] == rows[:-1])
    thrice = again.copy()
    thrice[2:] &= again[1:-1] & again[:-2]
    thrice[:3] = False
    letters = np.concatenate([[0], np.cumsum(_LETTER[s.text])])
    order = np.lexsort((s.hashes, rows))
    first = np.ones(len(rows), bool)
    first[1:] = (s.hashes[order][1:] != s.hashes[order][:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(s.rows)
    np.maximum.at(most, rows[at], np.diff(np.append(at, len(rows))))
    distinct = np.bincount(rows[at], minlength=s.rows)
    size = np.maximum(_per_row(s, NON_SPACE[s.text]), 1)
    columns = [_per_row(s, _UPPER[s.text]) / np.maximum(_per_row(s, _LETTER[s.text]), 1),
               _per_row(s, _ODD[s.text]) / size,
               share(again),
               share(letters[s.ends] == letters[s.starts]),
               share(_ODD[s.text[s.ends - 1]]),
               most / words,
               # usual text has about n ** 0.8 distinct words
               1 - distinct / words ** 0.8,
               share(thrice)]
    columns[2:] = [np.where(n >= LEAST_WORDS, c, 0.0) for c in columns[2:]]
    return np.stack(columns, 1), n


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """GOOD, ABSTAIN or BAD of each labeller for each row."""
    good = np.array([x.good for x in LABELLERS])
    bad = np.array([x.bad for x in LABELLERS])
    out = np.where(stats >= bad, BAD, np.where(stats <= good, GOOD, ABSTAIN))
    return np.where(n_words[:, None] > 0, out, ABSTAIN).astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return (v + 1).astype(np.int64) @ (3 ** np.arange(v.shape[1]))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


@dataclass
class LabelModel:
    """Share of good texts; for each labeller the rates of bad, no and good
    votes on bad texts (row 0) and on good ones (row 1)."""
    good: float
    rates: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        by = np.arange(v.shape[1])
        log = [np.log(p) + np.log(self.rates[by, c, v + 1]).sum(1) for c, p in ((0, 1 - self.good), (1, self.good))]
        return sigmoid(log[1] - log[0])


def _rates(bad: np.ndarray) -> np.ndarray:
    """Rates by labeller, class (bad, good) and vote from the rates of bad
    votes, within the assumed bounds.  An abstention tells nothing."""
    bad = np.stack([np.clip(bad[:, 0], *CATCHES), np.clip(bad[:, 1], 1e-4, FALSE_ALARMS)], 1)
    return np.stack([bad, np.ones_like(bad), 1 - bad], 2)


def expectation_maximisation(v: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Accuracies of conditionally independent labellers from the counts of
    vote patterns, within the assumed bounds (without them the two classes may
    settle on any split of the patterns)."""
    model = LabelModel(0.9, _rates(np.tile([[0.3, FALSE_ALARMS]], (v.shape[1], 1))))
    for _ in range(rounds if counts.sum() else 0):
        p = model.posterior(v)
        bad = np.empty((v.shape[1], 2))
        for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
            said = (weight[:, None] * (v == BAD)).sum(0)
            bad[:, c] = (said + 1) / (said + (weight[:, None] * (v == GOOD)).sum(0) + 2)
        model = LabelModel(float(np.clip((counts * p).sum() / counts.sum(), 1e-3, 1 - 1e-3)), _rates(bad))
    return model


def _shape_codes(s: Slice) -> np.ndarray:
    """Shape of each word: classes of its first and last two bytes, whether it
    repeats the one before, and its length up to 12."""
    c = _SHAPE[s.text]
    last, before = c[s.ends - 1], c[np.maximum(s.starts, s.ends - 2)]
    again = np.zeros(len(s.starts), np.uint64)
    again[1:] = s.hashes[1:] == s.hashes[:-1]
    size = np.minimum(s.ends - s.starts, 12).astype(np.uint64)
    return c[s.starts] | last << np.uint64(8) | before << np.uint64(16) | again << np.uint64(24) | size // np.uint64(4) << np.uint64(25)


def hashed(s: Slice, stats: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): hashed shapes and shape pairs of the words, as
    square roots of their shares; and each statistic's step of tenths."""
    codes, rows = _shape_codes(s), s.row_of_words()
    pairs = mix(codes[1:] * np.uint64(0x9E3779B97F4A7C15) + codes[:-1])
    inside = rows[1:] == rows[:-1]
    top = np.uint64(64 - bits)
    all_rows = np.concatenate([rows, rows[1:][inside]])
    buckets = np.concatenate([mix(codes + np.uint64(1)) >> top, pairs[inside] >> top]).astype(np.int64)
    both, n = np.unique(all_rows << bits | buckets, return_counts=True)
    r = both >> bits
    value = np.sqrt(n / np.maximum(np.diff(s.splits), 1)[r])
    steps = np.minimum(np.maximum(stats, 0) * 10, 15).astype(np.uint64) + (np.arange(stats.shape[1], dtype=np.uint64) + np.uint64(1) << np.uint64(40))
    extra = (mix(steps) >> top).astype(np.int64)
    some = np.diff(s.splits) > 0
    extra_rows = np.repeat(np.flatnonzero(some), stats.shape[1])
    return (np.concatenate([r, extra_rows]), np.concatenate([both & ((1 << bits) - 1), extra[some].ravel()]),
            np.concatenate([value, np.ones(len(extra_rows))]))


@dataclass
class Model:
    """The label model, and the scorer that its posterior labels trained."""
    labels: LabelModel
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = 0.0


def _slices(b: pa.RecordBatch, text: str = "text") -> Iterator[tuple[Slice, np.ndarray, np.ndarray]]:
    for s in scan(b.column(b.schema.get_field_index(text)), NON_SPACE, SAME):
        yield s, *statistics(s)


def vote_patterns(texts: DataFrame) -> DataFrame:
    """The vote pattern of each text (one column, ``pattern``)."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            out = [pattern(votes(stats, n)) for _, stats, n in _slices(b)]
            yield pa.record_batch([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["pattern"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long")


def features(texts: DataFrame) -> DataFrame:
    """pattern, and the hashed features (buckets, vals) of each text."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            codes, buckets, values = [np.zeros(0, np.int64)], [], []
            for s, stats, n in _slices(b):
                rows, found, vals = hashed(s, stats)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(1, s.rows))
                codes.append(pattern(votes(stats, n)))
                buckets += np.split(found[order].astype(np.int32), cuts)
                values += np.split(vals[order].astype(np.float32), cuts)
            yield pa.record_batch([pa.array(np.concatenate(codes)), pa.array(buckets, pa.list_(pa.int32())),
                                   pa.array(values, pa.list_(pa.float32()))], ["pattern", "buckets", "vals"])

    return texts.mapInArrow(run, "pattern long, buckets array<int>, vals array<float>")


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """Label model from all of ``docs``; scorer from ``sample`` rows at most."""
    counted = vote_patterns(docs).groupBy("pattern").count().toArrow()  # 3 ** labellers rows at most
    found, counts = counted["pattern"].to_numpy(), counted["count"].to_numpy().astype(float)
    model = Model(expectation_maximisation(votes_of(found), np.where(found == pattern(np.zeros((1, len(LABELLERS)), np.int8))[0], 0, counts)))
    if not counts.sum():
        return model
    hashed_rows = docs.select(F.xxhash64(id_col, F.coalesce(F.col("text"), F.lit(""))).alias("h"), "text")
    last = hashed_rows.select("h").orderBy("h").limit(sample).groupBy("h").count().orderBy(F.desc("h")).first()
    # the features are taken where the texts are; only of the last hash's equal rows some may be too many
    rows, x = gather(features(hashed_rows.where(F.col("h") < last.h).select("text")).unionByName(
        features(hashed_rows.where(F.col("h") == last.h).select("text").limit(last["count"]))))
    x.shape = (x.shape[0], 1 << BITS)
    target = model.labels.posterior(votes_of(rows["pattern"].to_numpy()))
    model.weights, model.bias = fit_soft(x, target, bias=0.0, ridge=1e-5)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the whole input row), ``pattern``, ``posterior`` (of the label
    model) and ``score``, the probability that the text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(frames):
            codes, out = [np.zeros(0, np.int64)], [np.zeros(0)]
            for s, stats, n in _slices(b):
                rows, found, vals = hashed(s, stats)
                codes.append(pattern(votes(stats, n)))
                out.append(sigmoid(np.bincount(rows, vals * m.weights[found], s.rows) + m.bias))
            p = np.concatenate(codes)
            yield pa.record_batch([b.column(0), pa.array(p), pa.array(m.labels.posterior(votes_of(p))),
                                   pa.array(np.concatenate(out))], ["row", "pattern", "posterior", "score"])

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, pattern long, posterior double, score double")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents that the scorer accepts, with the columns of ``docs``."""
    return score(docs, fit(docs)).where("score >= 0.5").select("row.*")
