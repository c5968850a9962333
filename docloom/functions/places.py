"""Places of tokens in their text, and back.

``token_ends`` holds the prefix sums of token lengths in code points; a token
span becomes a span of characters by two lookups, a span of characters becomes
the token span that covers it by binary search.

Defined results: null tokens have null ends, a null token counts as empty; spans
that lie outside, are reversed or hold a null give null; empty spans of
characters too.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the function runs in Python workers; see hooks.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ends(tokens: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.utf8_length(tokens.flatten()), 0).to_numpy(zero_copy_only=False)
    many = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    values = total[1:] - np.repeat(total[cuts[:-1]], many)
    gone = np.asarray(tokens.is_null().to_numpy(zero_copy_only=False), bool)
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)),
                                    mask=pa.array(gone) if len(tokens) else None)


def token_ends(tokens) -> Column:
    """The place after each token, from an array of strings that make up the text."""
    return F.arrow_udf(_ends, T.ArrayType(T.IntegerType()))(F.col(tokens) if isinstance(tokens, str) else tokens)


def chars_of_tokens(ends: Column, first: Column, last: Column) -> Column:
    """struct(start, end): the characters of tokens first .. last (both
    included); end is exclusive."""
    good = (first >= 0) & (first <= last) & (last < F.size(ends))
    start = F.when(first == 0, F.lit(0)).otherwise(F.get(ends, first - 1))
    return F.when(good, F.struct(start.cast("int").alias("start"), F.get(ends, last).cast("int").alias("end")))


def _first_beyond(ends: Column, place: Column) -> Column:
    """The first token whose end lies beyond ``place``, by halving."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        beyond = F.get(ends, mid) > place
        return (F.when(s["low"] >= s["high"], s)
                .when(beyond, F.struct(s["low"].alias("low"), mid.alias("high")))
                .otherwise(F.struct((mid + 1).alias("low"), s["high"].alias("high"))))

    whole = F.struct(F.lit(0).alias("low"), (F.size(ends) - 1).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ends) + 1)).cast("int"))
    return F.aggregate(steps, whole, halve, lambda s: s["low"])


def tokens_of_chars(ends: Column, start: Column, end: Column) -> Column:
    """struct(first, last): the smallest span of tokens that covers the
    characters start .. end - 1."""
    good = (start >= 0) & (start < end) & (end <= F.element_at(ends, -1))
    return F.when((F.size(ends) > 0) & good,
                  F.struct(_first_beyond(ends, start).alias("first"), _first_beyond(ends, end - 1).alias("last")))


def span_text(text: Column, chars: Column) -> Column:
    """The characters of a span; null where there is none."""
    return F.substring(text, chars["start"] + 1, chars["end"] - chars["start"])
