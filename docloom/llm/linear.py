"""Sparse logistic models in numpy, fitted on a bounded sample of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def log_loss(margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -margin)


@dataclass
class Sparse:
    """(row, column, value) triples of a matrix."""
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * w[self.cols], self.shape[0])

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.vals * g[self.rows], self.shape[1])


def gather(sample: DataFrame, buckets: str = "buckets", values: str | None = "vals") -> tuple[pa.Table, Sparse]:
    """A bounded sample on the driver: its other columns, and its features as
    a matrix of a row for each and a column for each bucket.  Columns are 32
    bits wide: the sample is the largest thing that the driver holds."""
    t = sample.toArrow()
    lists = t[buckets].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    vals = t[values].combine_chunks().flatten().to_numpy(zero_copy_only=False) if values else np.ones(len(cols), np.float32)
    dims = int(cols.max()) + 1 if len(cols) else 1
    other = t.select([c for c in t.column_names if c not in (buckets, values)])
    return other, Sparse(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), cols, vals, (len(sizes), dims))


def minimise(x: Sparse, gradient: Callable[[np.ndarray], np.ndarray], steps: int = 200, rate: float = 0.1,
             ridge: float = 1e-4, bias: float = 0.0) -> tuple[np.ndarray, float]:
    """Adam on weights and bias; ``gradient`` maps the rows' margins to the
    loss gradient by margin.  Deterministic: full batches, zero start."""
    w, b = np.zeros(x.shape[1]), bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = gradient(x.dot(w) + b)
        full = np.append(x.transposed_dot(g) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_soft(x: Sparse, target: np.ndarray, **how) -> tuple[np.ndarray, float]:
    """Logistic regression on labels between 0 and 1."""
    n = max(1, len(target))
    return minimise(x, lambda z: (sigmoid(z) - target) / n, **how)


def fit_nnpu(x: Sparse, positive: np.ndarray, prior: float, **how) -> tuple[np.ndarray, float]:
    """Non-negative positive-unlabelled learning (logistic loss): the risk
    ``prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])``; where the
    second part is negative its gradient is turned round."""
    unlabelled = ~positive
    np_, nu = max(1, positive.sum()), max(1, unlabelled.sum())

    def gradient(z: np.ndarray) -> np.ndarray:
        p = sigmoid(z)
        negative = log_loss(-z)
        rest = negative[unlabelled].sum() / nu - prior * negative[positive].sum() / np_
        as_negative = np.where(unlabelled, p / nu, -prior * p / np_)
        if rest < 0:
            return -as_negative
        return as_negative + np.where(positive, prior * (p - 1) / np_, 0.0)

    return minimise(x, gradient, **how)
