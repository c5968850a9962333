"""Decode and score predicted spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import text as tx


def decode(df: DataFrame, start_logits: str = "start_logits", end_logits: str = "end_logits",
           confidence: bool = True) -> DataFrame:
    """argmax of each logit array, swapped when reversed, plus the softmax
    probability of each argmax (softmax is monotone, so it does not change
    the argmax; it is only reported)."""
    s, e = sp.argmax(start_logits), sp.argmax(end_logits)
    lo, hi = sp.ordered_span(s, e)
    out = df.withColumn("pred_start", lo).withColumn("pred_end", hi)
    if confidence:
        out = (out.withColumn("start_confidence", sp.max_prob(start_logits))
               .withColumn("end_confidence", sp.max_prob(end_logits)))
    return out


def widening_attempts(step: int = 5, limit: int = 20) -> list[tuple[int, int]]:
    """(incre_num_by, cumulative offset) of every window the search tries.

    The limit is checked after the increment, so the first increment above
    the limit is still tried (Q7): limit 20 → 0, 5, 10, 15, 20, 25 with
    offsets 0, 5, 15, 30, 50, 75."""
    out, incre, off = [(0, 0)], 0, 0
    while incre <= limit:
        incre += step
        off += incre
        out.append((incre, off))
    return out


def whitespace_detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def widening_search(df: DataFrame, tokens: str = "input_ids", start: str = "pred_start",
                    end: str = "pred_end", categories: Sequence[str] = tuple(tx.DOC_ID_CATEGORIES),
                    step: int = 5, limit: int = 20,
                    detokenize: Callable[[Column], Column] = whitespace_detokenize,
                    whole_id: bool = False, keep_misses: bool = False) -> DataFrame:
    """Look for a doc id in the predicted span; on a miss widen both sides
    by 5, then 10, 15 … (cumulative) until an id is found or the limit is
    passed.  The window is clamped to the row (Q6).  Adds ``match``,
    ``category_pred``, ``retrieve`` (string) and ``incre_num_by``; rows with
    no id are dropped (P15) unless ``keep_misses``.  ``whole_id`` rejects a
    match directly followed by a digit inside the decoded window (an id cut
    by the window's own end still matches, as in the reference, Q22).

    Implemented as a short-circuit ``aggregate`` over the literal attempt
    list, so later (wider) windows are never decoded once an id is found."""
    pat = tx.doc_id_pattern(categories, whole_id)
    t, s, e = F.col(tokens), F.col(start), F.col(end)
    attempts = F.array(*[F.struct(F.lit(i).alias("incre"), F.lit(o).alias("off"))
                         for i, o in widening_attempts(step, limit)])
    none = F.lit(None).cast("struct<incre:int,m:string>")

    def step_fn(acc, a):
        m = F.regexp_extract(detokenize(sp.gather(t, s - a["off"], e + a["off"])), pat, 0)
        tried = F.when(m != "", F.struct(a["incre"].cast("int").alias("incre"), m.alias("m")))
        return F.when(acc.isNotNull(), acc).otherwise(tried)

    hit = F.aggregate(attempts, none, step_fn)
    # The search sits inside a generator so Catalyst evaluates it once per
    # row: a plain column would be inlined into the pushed-down filter and
    # into every column derived from it.
    gen = (F.inline(F.filter(F.array(hit), lambda h: h.isNotNull())) if not keep_misses
           else F.inline_outer(F.array(hit)))
    out = df.select("*", gen)
    parts = tx.split_doc_id(F.col("m"))
    return (out.withColumn("category_pred", parts["category"])
            .withColumn("retrieve", parts["number"])
            .withColumnRenamed("m", "match")
            .withColumnRenamed("incre", "incre_num_by"))


def span_metrics(df: DataFrame, pred: tuple[str, str] = ("pred_start", "pred_end"),
                 true: tuple[str, str] = ("true_start", "true_end"), end_inclusive: bool = True,
                 by: Sequence[str] = (), loss: str | None = None) -> DataFrame:
    """Mean precision, mean recall, exact-match rate (and mean loss)
    over rows, optionally per group.  One partial/final aggregate; rows with
    an empty predicted (true) span are left out of the precision (recall)
    mean, as in the reference."""
    sc = sp.span_scores(pred[0], pred[1], true[0], true[1], end_inclusive)
    aggs = [F.avg(sc["precision"]).alias("precision"), F.avg(sc["recall"]).alias("recall"),
            F.avg(sc["exact"].cast("double")).alias("exact_match"), F.count(F.lit(1)).alias("n")]
    if loss:
        aggs.append(F.avg(loss).alias("loss"))
    return df.groupBy(*by).agg(*aggs)
