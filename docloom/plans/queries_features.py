"""Registered queries: token windows, padding, subsequence labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as sp
from ..operators import features as fe
from ..operators import splits as sl
from . import oracle as O
from . import tables as TB
from .common import _docs
from .registry import register


# ---------------------------------------------------------------- features

WINDOW_MAX_LEN, WINDOW_OVERLAP = 64, 30


@register("token_windows", f"""WITH t AS (
  SELECT doc_id, ['Question', CAST(doc_id AS VARCHAR)] AS prompt, string_split(text, ' ') AS tokens FROM documents),
s AS (
  SELECT doc_id, prompt, tokens, {WINDOW_MAX_LEN} - len(prompt) AS w FROM t),
c AS (
  SELECT doc_id, prompt, tokens, w,
         unnest(range(0, CAST(ceil(greatest(len(tokens) - w, 0) / (w - {WINDOW_OVERLAP})) * (w - {WINDOW_OVERLAP}) AS BIGINT) + 1,
                      w - {WINDOW_OVERLAP})) AS token_start
  FROM s)
SELECT doc_id, CAST(token_start // (w - {WINDOW_OVERLAP}) AS BIGINT) AS chunk_no, CAST(token_start AS BIGINT) AS token_start,
       array_to_string(prompt || tokens[token_start + 1 : token_start + w], ' ') AS chunk_text,
       (token_start + w >= len(tokens)) AS is_last
FROM c""")
def token_windows(spark, d):
    df = _docs(spark, d).select("doc_id", fe.whitespace_tokens("text").alias("tokens"),
                                F.array(F.lit("Question"), F.col("doc_id").cast("string")).alias("prompt"))
    out = fe.token_windows(df, "tokens", width=0, overlap=WINDOW_OVERLAP, prompt="prompt", max_length=WINDOW_MAX_LEN)
    return out.select("doc_id", F.col("chunk_no").cast("long"), F.col("token_start").cast("long"),
                      F.array_join("chunk", " ").alias("chunk_text"), "is_last")


BATCH = 4


@register("pad_batches", f"""WITH t AS (
  SELECT item_id, string_split(text, ' ') AS tokens,
         (row_number() OVER (ORDER BY item_id) - 1) // {BATCH} AS batch_no FROM benchmark),
p AS (SELECT item_id, tokens, batch_no, max(len(tokens)) OVER (PARTITION BY batch_no) AS padded_len FROM t)
SELECT item_id, CAST(batch_no AS BIGINT) AS batch_no, CAST(padded_len AS BIGINT) AS padded_len,
       list_transform(range(padded_len), lambda i: CASE WHEN i < len(tokens) THEN 1 ELSE 0 END) AS attention_mask,
       array_to_string(tokens || list_transform(range(padded_len - len(tokens)), lambda i: '<pad>'), ' ') AS padded
FROM p""")
def pad_batches(spark, d):
    b = TB.table(spark, d, "benchmark").select("item_id", fe.whitespace_tokens("text").alias("tokens"))
    b = sl.batch_numbers(b, "item_id", BATCH)
    out = fe.pad_batches(b, "tokens", pad="<pad>", name="padded_tokens")
    return out.select("item_id", "batch_no", "padded_len", "attention_mask",
                      F.array_join("padded_tokens", " ").alias("padded"))


def _targets(spark, d):
    b = TB.table(spark, d, "benchmark").select("item_id", fe.whitespace_tokens("text").alias("tokens"))
    n = F.size("tokens")
    p = (F.col("item_id") * 7) % F.greatest(n - 1, F.lit(1))
    tgt = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("zzz"))).otherwise(
        F.slice("tokens", (p + 1).cast("int"), 2))
    return b.withColumn("target", tgt)


SQL_TARGETS = """t AS (SELECT item_id, string_split(text, ' ') AS tokens FROM benchmark),
g AS (SELECT item_id, tokens,
             CASE WHEN item_id % 3 = 0 THEN ['zzz']
                  ELSE tokens[(item_id * 7) % greatest(len(tokens) - 1, 1) + 1 : (item_id * 7) % greatest(len(tokens) - 1, 1) + 2] END AS target
      FROM t),
m AS (SELECT item_id, len(target) AS mlen,
             CASE WHEN len(target) > 0 AND len(target) <= len(tokens) THEN
               list_filter(range(0, len(tokens) - len(target) + 1), lambda i: tokens[i + 1 : i + len(target)] = target)
             ELSE [] END AS starts
      FROM g)"""


@register("subsequence_all", O.with_(SQL_TARGETS) + """
SELECT item_id,
       CASE WHEN len(starts) > 0 THEN CAST(starts AS BIGINT[]) ELSE [CAST(0 AS BIGINT)] END AS starts,
       CASE WHEN len(starts) > 0 THEN CAST(list_transform(starts, lambda s: s + mlen) AS BIGINT[]) ELSE [CAST(0 AS BIGINT)] END AS ends,
       len(starts) > 0 AS found
FROM m""")
def subsequence_all(spark, d):
    m = sp.find_subsequence("tokens", "target")
    return _targets(spark, d).select("item_id", m["starts"].alias("starts"), m["ends"].alias("ends"),
                                     m["found"].alias("found"))


@register("answer_span", O.with_(SQL_TARGETS) + """
SELECT item_id,
       CAST(CASE WHEN len(starts) > 0 THEN list_min(starts) ELSE 0 END AS BIGINT) AS start,
       CAST(CASE WHEN len(starts) > 0 THEN list_min(starts) + mlen ELSE 0 END AS BIGINT) AS "end",
       len(starts) > 0 AS found
FROM m""")
def answer_span(spark, d):
    s = sp.answer_span("tokens", "target")
    return _targets(spark, d).select("item_id", s["start"].alias("start"), s["end"].alias("end"),
                                     s["found"].alias("found"))

# ---------------------------------------------------------------- chunk labels

LABEL_MAX_LEN, LABEL_OVERLAP = 48, 16


def _label_input(spark, d):
    """documents as whitespace tokens with the answer id planted at a known
    token; the answer target is the id split in two tokens so it can straddle
    a window edge."""
    t = _docs(spark, d).select("doc_id", fe.whitespace_tokens("text").alias("tk"))
    n = F.size("tk")
    p = ((F.col("doc_id") * 17) % n).cast("int")
    ans = F.array(F.lit("finance"), F.col("doc_id").cast("string"))
    tokens = F.concat(F.slice("tk", 1, p), ans, F.slice("tk", p + 1, n - p))
    return t.select("doc_id", tokens.alias("tokens"), ans.alias("target"),
                    F.array(F.lit("Q"), F.col("doc_id").cast("string")).alias("prompt"))


@register("chunk_labels", f"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS tk FROM documents),
a AS (
  SELECT doc_id, ['finance', CAST(doc_id AS VARCHAR)] AS target, ['Q', CAST(doc_id AS VARCHAR)] AS prompt,
         tk[1 : (doc_id * 17) % len(tk)] || ['finance', CAST(doc_id AS VARCHAR)] || tk[(doc_id * 17) % len(tk) + 1 :] AS tokens
  FROM t),
s AS (SELECT *, {LABEL_MAX_LEN} - len(prompt) AS w FROM a),
c AS (
  SELECT doc_id, target, prompt, tokens, w,
         unnest(range(0, CAST(ceil(greatest(len(tokens) - w, 0) / (w - {LABEL_OVERLAP})) * (w - {LABEL_OVERLAP}) AS BIGINT) + 1,
                      w - {LABEL_OVERLAP})) AS token_start
  FROM s),
k AS (SELECT doc_id, token_start, w, target, prompt || tokens[token_start + 1 : token_start + w] AS chunk FROM c),
m AS (SELECT doc_id, token_start, w, len(target) AS mlen,
             list_filter(range(0, len(chunk) - len(target) + 1), lambda i: chunk[i + 1 : i + len(target)] = target) AS starts
      FROM k)
SELECT doc_id, CAST(token_start // (w - {LABEL_OVERLAP}) AS BIGINT) AS chunk_no,
       CAST(CASE WHEN len(starts) > 0 THEN list_min(starts) ELSE 0 END AS BIGINT) AS start_positions,
       CAST(CASE WHEN len(starts) > 0 THEN list_min(starts) + mlen ELSE 0 END AS BIGINT) AS end_positions,
       len(starts) > 0 AS found
FROM m""")
def chunk_labels(spark, d):
    """W2 + F23/F24 per chunk: the reference's feature mapping on whitespace
    tokens: prompt-led overlapping windows, each labelled with the earliest
    answer span inside it (end exclusive) and a ``found`` flag."""
    w = fe.token_windows(_label_input(spark, d), "tokens", width=0, overlap=LABEL_OVERLAP,
                         prompt="prompt", max_length=LABEL_MAX_LEN)
    out = fe.label_chunks(w, "chunk", "target")
    return out.select("doc_id", F.col("chunk_no").cast("long"), "start_positions", "end_positions", "found")
