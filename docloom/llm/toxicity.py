"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers
are trained from confirmed toxic examples and unlabelled text with a risk
estimator corrected by the class prior, and score every whole text.

Features are the distinct words of a text (runs of digits, a-z after
lower-casing A-Z, and non-ASCII characters), hashed into ``2**BITS`` buckets;
the ``FEATURES`` buckets at most that tell the two samples apart are used.  The
sample is bounded: ``POSITIVES`` confirmed and ``UNLABELLED`` other rows, those
with the smallest hash of their id; both are documented parameters.

Defined results: null or empty text scores as text without known words; with
no confirmed example, or no unlabelled row, every score is the class prior (0
without labels); repeated labels count once, and a row that any label calls
toxic is an example; rows with a null id are scored but never learnt from;
only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Sparse, fit_nnpu, gather, sigmoid
from .words import ALNUM, Slice, batches, scan

BITS = 24
POSITIVES, UNLABELLED, FEATURES = 5_000, 10_000, 2_048
#: Rows of the confirmed sample in which a bucket has to occur.
LEAST_ROWS = 3
#: Standard errors by which a bucket's shares in the two samples have to differ.
LEAST_Z = 4.0


@dataclass
class Model:
    """A weight for each kept bucket (sorted), and the bias."""
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _buckets(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a slice."""
    pairs = np.unique((s.row_of_words() << BITS) | (s.hashes >> np.uint64(64 - BITS)).astype(np.int64))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def features(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` but ``text``, with the distinct buckets of the text."""
    kept = [c for c in texts.columns if c != "text"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            lists = []
            for s in scan(b.column(b.schema.get_field_index("text")), ALNUM):
                rows, found = _buckets(s)
                lists += np.split(found.astype(np.int32), np.searchsorted(rows, np.arange(1, s.rows)))
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(lists, pa.list_(pa.int32()))],
                                  [*kept, "buckets"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, f"{kinds}, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES,
        unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Train on the rows of ``docs`` (doc_id, text) for which ``learn`` (over
    doc_id) holds.  The class prior is the toxic share of the labels there,
    unless given."""
    known = (labels.where(learn & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int")).alias("y")))
    if prior is None:
        prior = known.agg(F.avg((F.col("y") == 1).cast("double")).alias("p")).first().p or 0.0
    order = F.xxhash64("doc_id")
    confirmed = known.where("y = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("y"))
    others = (docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id")
              .orderBy(order, "doc_id").limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("y")))
    picked = confirmed.unionByName(others)  # positives + unlabelled rows at most: bounded
    sample = docs.join(F.broadcast(picked), "doc_id").select("y", "doc_id", "text").dropDuplicates(["y", "doc_id"])
    rows, x = gather(features(sample), values=None)
    positive = rows["y"].to_numpy() == 1
    if not positive.any() or positive.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    keep = _telling(x, positive)
    at = np.searchsorted(keep, x.cols)
    inside = keep[np.minimum(at, len(keep) - 1)] == x.cols if len(keep) else np.zeros(len(at), bool)
    small = Sparse(x.rows[inside], at[inside], x.vals[inside], (x.shape[0], len(keep)))
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    w, bias = fit_nnpu(small, positive, prior, ridge=3e-5, bias=float(np.log(prior / (1 - prior))))
    return Model(keep, w, bias)


def _telling(x: Sparse, positive: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Sorted buckets whose shares in the two samples differ most, in standard errors."""
    buckets, index = np.unique(x.cols, return_inverse=True)
    in_p = np.bincount(index, positive[x.rows], len(buckets))
    n_p, n_u = positive.sum(), (~positive).sum()
    p, u = in_p / n_p, (np.bincount(index, minlength=len(buckets)) - in_p) / n_u
    both = (p * n_p + u * n_u) / (n_p + n_u)
    z = np.abs(p - u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    z[in_p < min(LEAST_ROWS, n_p)] = 0
    best = np.lexsort((buckets, -z))[:most]
    return np.sort(buckets[best[z[best] > LEAST_Z]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the whole input row) and ``score``, the probability of toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(frames):
            out = [np.zeros(0)]
            for s in scan(b.column(1), ALNUM):
                rows, found = _buckets(s)
                total = np.full(s.rows, m.bias)
                if len(m.buckets):
                    at = np.minimum(np.searchsorted(m.buckets, found), len(m.buckets) - 1)
                    total += np.bincount(rows, np.where(m.buckets[at] == found, m.weights[at], 0.0), s.rows)
                out.append(sigmoid(total))
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(out))], ["row", "score"])

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, score double")
