"""Subsequence search in time linear in tokens and target.

Knuth, Morris and Pratt: a table of the target's own borders tells where to go
on after a token that doesn't fit, so no token is looked at twice.  Spark's
higher-order functions have no loop for that step, so the search runs over Arrow
batches, on the numbers that tokens and targets have in the batch's dictionary.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

# the functions below run in Python workers; see sources/hooks.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def borders(target: list[int]) -> list[int]:
    """For each prefix of the target: the length of its longest proper border."""
    out, k = [0] * len(target), 0
    for i in range(1, len(target)):
        while k and target[i] != target[k]:
            k = out[k - 1]
        k += target[i] == target[k]
        out[i] = k
    return out


def occurrences(tokens: list[int], target: list[int]) -> list[int]:
    """Where the target starts in the tokens, overlapping ones too."""
    out, k, m = [], 0, len(target)
    if not m or m > len(tokens):
        return out
    back = borders(target)
    for i, x in enumerate(tokens):
        while k and x != target[k]:
            k = back[k - 1]
        k += x == target[k]
        if k == m:
            out.append(i - m + 1)
            k = back[m - 1]
    return out


def _coded(tokens: pa.Array, targets: pa.Array):
    """For each row its tokens and its target as numbers and where it occurs
    (a null target, and one that starts with a null token, doesn't); None for
    null tokens."""
    flat = pa.concat_arrays([tokens.flatten(), targets.flatten().cast(tokens.type.value_type)])
    codes = flat.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    at, begin = 0, len(tokens.flatten())
    for n, m in zip(tokens.value_lengths().to_pylist(), targets.value_lengths().to_pylist(), strict=True):
        t, g = codes[at:at + (n or 0)], codes[begin:begin + (m or 0)]
        at, begin = at + (n or 0), begin + (m or 0)
        yield None if n is None else (t, g, [] if not len(g) or g[0] < 0 or not (t == g[0]).any() else occurrences(t.tolist(), g.tolist()))


@F.arrow_udf(ArrayType(IntegerType()))
def subsequence_starts(tokens: pa.Array, targets: pa.Array) -> pa.Array:
    """Starts of every occurrence; null tokens in a target equal null tokens,
    but for its first.  Null tokens give null."""
    return pa.array([None if x is None else x[2] for x in _coded(tokens, targets)], pa.list_(pa.int32()))


@F.arrow_udf(ArrayType(BooleanType()))
def subsequence_mask(tokens: pa.Array, targets: pa.Array) -> pa.Array:
    """Whether each token is inside an occurrence.  Null tokens give null."""
    out = []
    for x in _coded(tokens, targets):
        if x is None:
            out.append(None)
            continue
        t, g, starts = x
        edge = np.zeros(len(t) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.array(starts, np.int64) + len(g), -1)
        out.append(np.cumsum(edge)[:-1] > 0)
    return pa.array(out, pa.list_(pa.bool_()))
