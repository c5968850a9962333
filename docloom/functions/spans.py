"""Array and span functions (F23-F26, F28-F32, U3, W3): ``Column -> Column``.

All are closed-form arithmetic or higher-order functions evaluated inside the
row: no shuffle, and no Python but for the search of ``find_subsequence`` and
``match_mask``.  Closed forms and array builtins run in
whole-stage codegen; lambdas (``transform``/``filter``/``aggregate``) are
interpreted, so the hot paths avoid per-element lambdas where a builtin does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .search import subsequence_mask, subsequence_starts


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def argmax(arr) -> Column:
    """index of the first maximum (0-based); null for an empty array."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def softmax(arr) -> Column:
    """softmax over an array (double precision)."""
    a = _c(arr)
    m = F.array_max(a).cast("double")
    ex = F.transform(a, lambda x: F.exp(x.cast("double") - m))
    s = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / s)


def max_prob(arr) -> Column:
    """Confidence of the argmax: ``1 / sum(exp(x - max))``."""
    a = _c(arr)
    m = F.array_max(a).cast("double")
    s = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x.cast("double") - m))
    return F.lit(1.0) / s


def ordered_span(start, end) -> tuple[Column, Column]:
    """swap start/end when reversed."""
    s, e = _c(start), _c(end)
    return F.least(s, e), F.greatest(s, e)


def span_ids(start, end) -> Column:
    """inclusive span expanded to its ids (empty when start > end)."""
    s, e = _c(start), _c(end)
    return F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<long>"))


def span_len(start, end) -> Column:
    s, e = _c(start), _c(end)
    return F.greatest(F.lit(0), e - s + 1)


def span_overlap(s1, e1, s2, e2) -> Column:
    """|[s1,e1] ∩ [s2,e2]| for inclusive integer spans, no arrays built."""
    return F.greatest(F.lit(0), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)) + 1)


def span_scores(ps, pe, ts, te, end_inclusive: bool = True) -> Column:
    """struct(precision, recall, exact) for one row; precision (recall)
    is null when the predicted (true) span is empty, so means skip it."""
    ps, pe, ts, te = _c(ps), _c(pe), _c(ts), _c(te)
    if not end_inclusive:
        pe, te = pe - 1, te - 1
    inter = span_overlap(ps, pe, ts, te)
    lp, lt = span_len(ps, pe), span_len(ts, te)
    return F.struct(
        F.when(lp > 0, inter / lp).alias("precision"),
        F.when(lt > 0, inter / lt).alias("recall"),
        ((ps == ts) & (pe == te)).cast("int").alias("exact"),
    )


def gather(arr, start, end) -> Column:
    """elements ``start..end`` inclusive, clamped to the array (Q6)."""
    a, s, e = _c(arr), _c(start), _c(end)
    lo = F.greatest(s, F.lit(0))
    hi = F.least(e, F.size(a) - 1)
    return F.slice(a, (lo + 1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))


def find_subsequence(tokens, target) -> Column:
    """struct(starts, ends) of every occurrence of ``target`` in
    ``tokens`` (ends exclusive); ``[0], [0]`` when there is none, as the
    reference returns.  Linear in both (see ``search``); a target that starts or
    ends with a null token isn't found."""
    t, g = _c(tokens), _c(target)
    m = F.size(g)
    whole = F.coalesce((m > 0) & F.get(g, m - 1).isNotNull(), F.lit(False))
    starts = F.when(whole, F.coalesce(subsequence_starts(t, g), F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    found = F.size(starts) > 0
    return F.struct(
        F.when(found, starts).otherwise(F.array(F.lit(0))).cast("array<long>").alias("starts"),
        F.when(found, F.transform(starts, lambda s: s + m)).otherwise(F.array(F.lit(0)))
        .cast("array<long>").alias("ends"),
        found.alias("found"),
    )


# A separator that never occurs inside a token (a C0 control character).
TOKEN_SEPARATOR = "\u0001"
# Stands for a NULL token; no token either.
NULL_TOKEN = "\u0002"


def earliest_match(tokens, target) -> Column:
    """Token index of the first occurrence of ``target`` in ``tokens`` (-1 if
    none), by string search: both sides are joined with a separator that
    cannot occur in a token and framed by it, so only whole-token alignments
    match; the index is the number of separators before the hit.  One
    ``instr`` pass in codegen instead of a slice per position.  Tokens are
    compared as strings (ints are cast).  A NULL token keeps its place and
    equals nothing: a target with a NULL token is not found."""
    sep = TOKEN_SEPARATOR
    t, g = _c(tokens).cast("array<string>"), _c(target).cast("array<string>")
    hay = F.concat(F.lit(sep), F.array_join(t, sep, NULL_TOKEN), F.lit(sep))
    needle = F.concat(F.lit(sep), F.array_join(g, sep), F.lit(sep))
    pos = F.instr(hay, needle)
    before = F.substring(hay, 1, pos)
    idx = F.length(before) - F.length(F.replace(before, F.lit(sep), F.lit(""))) - 1
    ok = (pos > 0) & (F.size(g) > 0) & ~F.exists(g, lambda x: x.isNull())
    return F.when(ok, idx).otherwise(F.lit(-1)).cast("long")


def answer_span(tokens, target) -> Column:
    """earliest match as struct(start, end) with end exclusive, plus a
    ``found`` flag so "(0, 0) = not found" is not ambiguous (Q2)."""
    i = earliest_match(tokens, target)
    found = i >= 0
    return F.struct(F.when(found, i).otherwise(F.lit(0)).cast("long").alias("start"),
                    F.when(found, i + F.size(_c(target))).otherwise(F.lit(0)).cast("long").alias("end"),
                    found.alias("found"))


def match_mask(tokens, target) -> Column:
    """F23 ``return_mask``: boolean per token, true inside any occurrence.
    Linear in tokens and target, whatever the number of matches (see ``search``)."""
    return subsequence_mask(_c(tokens), _c(target))


def pad_to(arr, length, pad) -> Column:
    """F32: right-pad ``arr`` to ``length`` with ``pad``."""
    a = _c(arr)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(_c(length) - F.size(a), F.lit(0)).cast("int")))


def attention_mask(arr, length) -> Column:
    """F32: 1 for real tokens, 0 for padding, up to ``length`` (two
    ``array_repeat`` calls, no per-element lambda)."""
    a = _c(arr)
    real = F.least(F.size(a), _c(length).cast("int"))
    return F.concat(F.array_repeat(F.lit(1), real),
                    F.array_repeat(F.lit(0), F.greatest(_c(length).cast("int") - real, F.lit(0))))
