"""Registered queries: decoding, span metrics and the widening id search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places as pl
from ..functions import spans as sp
from ..operators import decode as dc
from ..operators import features as fe
from . import oracle as O
from . import tables as TB
from .common import _docs
from .registry import register


# ---------------------------------------------------------------- spans

@register("span_argmax", O.with_(O.LOGITS) + """
SELECT vec_id,
       CAST(least(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS BIGINT) AS pred_start,
       CAST(greatest(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS BIGINT) AS pred_end
FROM logits""")
def span_argmax(spark, d):
    return dc.decode(TB.logits(spark, d), confidence=False).select("vec_id", "pred_start", "pred_end")


@register("span_softmax", O.with_(O.LOGITS) + """
SELECT vec_id,
       round(1.0 / list_sum(list_transform(start_logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(start_logits) AS DOUBLE)))), 6) AS start_confidence,
       round(1.0 / list_sum(list_transform(end_logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(end_logits) AS DOUBLE)))), 6) AS end_confidence
FROM logits""")
def span_softmax(spark, d):
    out = dc.decode(TB.logits(spark, d))
    return out.select("vec_id", F.round("start_confidence", 6).alias("start_confidence"),
                      F.round("end_confidence", 6).alias("end_confidence"))


@register("span_metrics", O.with_(O.LOGITS, """p AS (
  SELECT vec_id, true_start, true_end,
         least(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS ps,
         greatest(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS pe
  FROM logits),
s AS (
  SELECT true_start, greatest(0, least(pe, true_end) - greatest(ps, true_start) + 1) AS inter,
         greatest(0, pe - ps + 1) AS lp, greatest(0, true_end - true_start + 1) AS lt,
         CASE WHEN ps = true_start AND pe = true_end THEN 1.0 ELSE 0.0 END AS ex
  FROM p)""") + """
SELECT true_start, round(avg(CASE WHEN lp > 0 THEN inter / lp END), 6) AS precision,
       round(avg(CASE WHEN lt > 0 THEN inter / lt END), 6) AS recall,
       round(avg(ex), 6) AS exact_match, count(*) AS n
FROM s GROUP BY true_start""")
def span_metrics(spark, d):
    out = dc.span_metrics(dc.decode(TB.logits(spark, d), confidence=False), by=["true_start"])
    return out.select("true_start", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "exact_match")], "n")


WIDEN_STEP, WIDEN_LIMIT = 5, 20


def planted_tokens(spark, d):
    t = planted(_docs(spark, d))
    m = F.size("tokens")
    ps = (F.col("doc_id") * 7) % m
    return t.withColumn("pred_start", ps).withColumn("pred_end", ps + F.col("doc_id") % 3)


def planted(docs, *more):
    """doc_id, further columns as asked, and the text's tokens with the id among them."""
    t = docs.select("doc_id", *more, fe.whitespace_tokens("text").alias("tk"))
    n = F.size("tk")
    p = ((F.col("doc_id") * 13) % n).cast("int")
    tokens = F.concat(F.slice("tk", 1, p), F.array(F.concat(F.lit("faq_"), F.col("doc_id").cast("string"))),
                      F.slice("tk", p + 1, n - p))
    return t.select("doc_id", *more, tokens.alias("tokens"))


@register("widening_search", f"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS tk FROM documents),
t2 AS (SELECT doc_id, tk[1 : (doc_id * 13) % len(tk)] || ['faq_' || CAST(doc_id AS VARCHAR)] || tk[(doc_id * 13) % len(tk) + 1 :] AS tokens FROM t),
s AS (SELECT doc_id, tokens, (doc_id * 7) % len(tokens) AS ps, (doc_id * 7) % len(tokens) + doc_id % 3 AS pe FROM t2),
a AS (SELECT doc_id, tokens, ps, pe, unnest(range({WIDEN_LIMIT // WIDEN_STEP + 2})) AS k FROM s),
tried AS (
  SELECT doc_id, k * {WIDEN_STEP} AS incre,
         regexp_extract(array_to_string(tokens[greatest(ps - {WIDEN_STEP} * k * (k + 1) // 2, 0) + 1 :
                                               least(pe + {WIDEN_STEP} * k * (k + 1) // 2, len(tokens) - 1) + 1], ' '),
                        '(?:insurance|finance|faq)_[0-9]+') AS m
  FROM a)
SELECT doc_id, split_part(arg_min(m, incre), '_', 1) AS category_pred, split_part(arg_min(m, incre), '_', 2) AS retrieve,
       CAST(min(incre) AS INTEGER) AS incre_num_by
FROM tried WHERE m <> '' GROUP BY doc_id""")
def widening_search(spark, d):
    out = dc.widening_search(planted_tokens(spark, d), tokens="tokens", step=WIDEN_STEP, limit=WIDEN_LIMIT)
    return out.select("doc_id", "category_pred", "retrieve", "incre_num_by")


@register("span_metrics_summary", O.with_(O.LOGITS, """p AS (
  SELECT true_start, true_end,
         least(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS ps,
         greatest(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS pe,
         ln(list_sum(list_transform(start_logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(start_logits) AS DOUBLE))))) AS loss
  FROM logits),
s AS (
  SELECT loss, greatest(0, least(pe, true_end) - greatest(ps, true_start) + 1) AS inter,
         greatest(0, pe - ps + 1) AS lp, greatest(0, true_end - true_start + 1) AS lt,
         CASE WHEN ps = true_start AND pe = true_end THEN 1.0 ELSE 0.0 END AS ex
  FROM p)""") + """
SELECT round(avg(CASE WHEN lp > 0 THEN inter / lp END), 6) AS precision, round(avg(CASE WHEN lt > 0 THEN inter / lt END), 6) AS recall,
       round(avg(ex), 6) AS exact_match, count(*) AS n, round(avg(loss), 6) AS loss
FROM s""")
def span_metrics_summary(spark, d):
    """A4: the one-row summary, with the mean loss (of the start's argmax)."""
    out = dc.decode(TB.logits(spark, d)).withColumn("loss", -F.log("start_confidence"))
    out = dc.span_metrics(out, loss="loss")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "exact_match")], "n", F.round("loss", 6).alias("loss"))


@register("match_mask", """WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS tk FROM documents),
m AS (SELECT doc_id, tk, CASE WHEN len(tk) > 1 THEN list_filter(range(0, len(tk) - 1), lambda i: tk[i + 1] = tk[1] AND tk[i + 2] = tk[2])
                              ELSE range(0, 1) END AS s FROM t)
SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct(CASE WHEN len(tk) > 1 THEN list_concat(s, list_transform(s, lambda i: i + 1)) ELSE s END)) AS BIGINT) AS n_masked FROM m""")
def match_mask(spark, d):
    """F23 with ``return_mask``: tokens inside any occurrence of the document's
    first two (of its only one, if it has no two; a null text is one empty token)."""
    t = _docs(spark, d).select("doc_id", fe.whitespace_tokens(F.coalesce("text", F.lit(""))).alias("tk"))
    mask = sp.match_mask(F.col("tk"), F.slice("tk", 1, 2))
    return t.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.size(F.filter(mask, lambda x: x)).cast("long").alias("n_masked"))


@register("answer_text_places", """WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), ' *[^ ]+| +$') AS tk FROM documents),
s AS (SELECT doc_id, tk, doc_id % len(tk) AS f, least(doc_id % len(tk) + 4, len(tk) - 1) AS l FROM t WHERE len(tk) > 0)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(tk[1:f], lambda x: length(x))), 0) AS INTEGER) AS char_start,
       md5(array_to_string(tk[f + 1:l + 1], '')) AS span_md5, CAST(f AS INTEGER) AS first, CAST(l AS INTEGER) AS last
FROM s UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM t WHERE len(tk) = 0""")
def answer_text_places(spark, d):
    """a span of tokens in each document, found in its text and taken back
    from there to tokens."""
    text = F.coalesce("text", F.lit(""))
    docs = _docs(spark, d).select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(" *[^ ]+| +$"), 0).alias("tokens"))
    ends = docs.select("doc_id", "text", pl.token_ends("tokens").alias("ends"))
    first = F.when(F.size("ends") > 0, F.col("doc_id") % F.greatest(F.size("ends"), F.lit(1))).cast("int")
    chars = pl.chars_of_tokens(F.col("ends"), first, F.least(first + 4, F.size("ends") - 1))
    found = ends.withColumn("chars", chars)
    back = pl.tokens_of_chars(F.col("ends"), F.col("chars.start"), F.col("chars.end"))
    return found.withColumn("back", back).select(
        "doc_id", F.col("chars.start").alias("char_start"), F.md5(pl.span_text(F.col("text"), F.col("chars")).cast("binary")).alias("span_md5"),
        "back.first", "back.last")
