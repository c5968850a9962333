"""Registered queries: callbacks per group, texts in segments, whole prompts,
slices deep in a table."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..operators import corpus as cp
from ..operators import features as fe
from ..operators import splits as sl
from ..operators.groups import fold_groups
from . import oracle as O
from . import tables as TB
from .common import NL, _sql_strip
from .queries_corpus import FAQ_SQL
from .queries_qa import context_assembly
from .registry import ORACLE, register


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the callbacks below run in Python workers


# ---------------------------------------------------------------- X3

def _none():
    return None


def _lengths(state, batch):
    """(rows, neighbours of which the later text is longer, first and last length) so far."""
    n = batch.column(batch.schema.get_field_index("n_chars")).to_numpy(zero_copy_only=False)
    return _joined_lengths(state, (len(n), int((np.diff(n) > 0).sum()), int(n[0]), int(n[-1])))


def _joined_lengths(a, b):
    return b if a is None else (a[0] + b[0], a[1] + b[1] + (b[2] > a[3]), a[2], b[3])


def _as_columns(state):
    return dict(zip(("n", "rises", "first_chars", "last_chars"), state, strict=True))


@register("group_callback", """WITH p AS (
  SELECT lang, source, doc_id, n_chars, lag(n_chars) OVER (PARTITION BY lang, source ORDER BY doc_id) AS before FROM documents)
SELECT lang, source, count(*) AS n, count(CASE WHEN n_chars > before THEN 1 END) AS rises,
       CAST(arg_min(n_chars, doc_id) AS BIGINT) AS first_chars, CAST(arg_max(n_chars, doc_id) AS BIGINT) AS last_chars
FROM p GROUP BY lang, source""")
def group_callback(spark, d):
    """How often a source's next document is longer, by a callback over
    batches of the source's documents in order."""
    docs = TB.table(spark, d, "documents").select("lang", "source", "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return fold_groups(docs, ["lang", "source"], "doc_id", _none, _lengths, _joined_lengths, _as_columns,
                       "n long, rises long, first_chars long, last_chars long")


# ---------------------------------------------------------------- A1, A9 in segments

SEGMENT_CHARS = 400


def _sql_segments(parts: str, key: str, order: str) -> str:
    """Segments of ``parts`` (key, order columns, piece)."""
    return f"""
w AS (SELECT *, coalesce(length(piece), 0) AS chars,
             coalesce(sum(coalesce(length(piece), 0)) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM {parts}),
g AS (SELECT *, CAST((CASE WHEN chars > 0 THEN before ELSE greatest(before - 1, 0) END) // {SEGMENT_CHARS} AS BIGINT) AS segment_no FROM w),
segments AS (SELECT {key}, segment_no, string_agg(piece, '' ORDER BY {order}) AS content FROM g GROUP BY {key}, segment_no)"""


@register("page_segments", f"""WITH parts AS (
  SELECT conv_id AS doc_id, turn, CASE WHEN {_sql_strip('text')} <> '' THEN '<page number="' || CAST(turn AS VARCHAR) || '">' || {_sql_strip('text')} || '</page>' END AS piece
  FROM conversations), {_sql_segments('parts', 'doc_id', 'turn')}
SELECT doc_id, segment_no, content FROM segments""")
def page_segments(spark, d):
    pages = TB.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return cp.pages_to_segments(pages, SEGMENT_CHARS)


@register("faq_segments", O.with_(FAQ_SQL, f"""pieces AS (
  SELECT faqid, 0 AS part, rec, question AS piece FROM r2 WHERE question IS NOT NULL
  UNION ALL SELECT faqid, 1, rec, a FROM r2 WHERE a IS NOT NULL),
parts AS (
  SELECT faqid, part, n, CASE WHEN n > 1 THEN {NL} ELSE '' END || piece AS piece
  FROM (SELECT *, row_number() OVER (PARTITION BY faqid, part ORDER BY rec) AS n FROM pieces)
  UNION ALL SELECT DISTINCT faqid, 0, 0, '{cp.FAQ_QUESTION_PREFIX}' FROM r2
  UNION ALL SELECT DISTINCT faqid, 1, 0, '{cp.FAQ_ANSWER_PREFIX}' FROM r2)""", _sql_segments('parts', 'faqid', 'part, n')) + """
SELECT 'faq' AS category, segment_no, content, CAST(length(content) AS BIGINT) AS content_len, faqid AS doc_num FROM segments""")
def faq_segments(spark, d):
    out = cp.faq_segments(cp.faq_records(TB.table(spark, d, "conversations")), SEGMENT_CHARS)
    return out.withColumn("content_len", F.col("content_len").cast("long"))


# ---------------------------------------------------------------- F12, whole prompts

EXAMPLE = "問題：「範例」這個問題可以在什麼編號的參考資料中找到答案？"


def _sql_turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || {NL} || {content} || '<|im_end|>' || {NL}"


def _sql_prompt(task: str, asked: str, context: str) -> str:
    return f"""SELECT qid, '{task}' AS task,
  {_sql_turn('system', f"'{fe.SYSTEM_MESSAGE}'")}
  || CASE WHEN qid % 3 = 0 THEN '' ELSE {_sql_turn('user', f"'{EXAMPLE}'")} || {_sql_turn('assistant', f"'{fe.ASSISTANT_ACK}'")} END
  || {_sql_turn('user', f"{_sql_strip(asked)} || {context}")}
  || CASE WHEN qid % 2 = 0 THEN {_sql_turn('assistant', 'answer_in_articleid')} ELSE '' END AS chat
FROM qa"""


@register("prompt_messages", f"WITH qa AS ({ORACLE['context_assembly']}) " + _sql_prompt(
    "find_id", f"'問題：「' || question || '」這個問題可以在什麼編號的參考資料中找到答案？' || {NL} || '參考資料：'",
    "'<context>' || context || '</context>'") + " UNION ALL " + _sql_prompt(
    "answer", f"'問題：' || question || {NL} || '參考資料：'", "context"))
def prompt_messages(spark, d):
    """both tasks' prompts with system message, example turn (where qid is
    no multiple of 3), acknowledgement, and the answer where qid is even."""
    qs = context_assembly(spark, d).withColumn("said", F.expr("CASE WHEN qid % 2 = 0 THEN answer_in_articleid END"))
    example = F.when(F.col("qid") % 3 != 0, F.lit(EXAMPLE))
    tasks = [F.struct(F.lit(t).alias("task"), fe.render_chat(fe.prompt_messages(task=t, example=example, answer="said")).alias("chat"))
             for t in ("find_id", "answer")]
    return qs.select("qid", F.inline(F.array(*tasks)))


# ---------------------------------------------------------------- O2, deep in the table

SLICE = (2_000, 45_000)


@register("slice_deep", f"""SELECT event_id, CAST(position AS BIGINT) AS position FROM (
  SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS position FROM events)
WHERE position >= {SLICE[0]} AND position < {SLICE[1]}""")
def slice_deep(spark, d):
    """O2: a slice whose end is beyond what one task should gather."""
    return sl.slice_rows(TB.table(spark, d, "events").select("event_id"), "event_id", *SLICE)
