"""Registered queries: QA assembly, prompts, features, folds and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect as co
from ..operators import decode as dc
from ..operators import features as fe
from ..operators import qa
from ..operators import splits as sl
from ..operators.ranks import range_partitions
from . import oracle as O
from . import tables as TB
from .common import NL, _sql_strip
from .registry import register
from .queries_features import WINDOW_OVERLAP
from .queries_spans import planted


# ---------------------------------------------------------------- QA assembly

@register("context_assembly", O.with_(O.QUESTIONS, """qa AS (
  SELECT questions.qid, translate(questions.query, '「」', '『』') AS question, questions.category,
         questions.source, truths.retrieve
  FROM questions JOIN truths USING (qid, category)),
refs AS (SELECT qid, category, unnest(source) AS doc_num, unnest(range(len(source))) AS pos FROM qa),
pieces AS (
  SELECT r.qid, r.category, r.pos,
         '<article id="' || r.category || '_' || CAST(r.doc_num AS VARCHAR) || '">' || d.text || '</article>' AS piece
  FROM refs r JOIN documents d ON d.lang = r.category AND d.doc_id = r.doc_num),
ctx AS (SELECT qid, category, string_agg(piece, '' ORDER BY pos) AS context FROM pieces GROUP BY qid, category)""") + """
SELECT qa.qid, qa.question, qa.category, coalesce(ctx.context, '') AS context,
       qa.category || '_' || CAST(qa.retrieve AS VARCHAR) AS answer_in_articleid
FROM qa LEFT JOIN ctx USING (qid, category)""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    qs = TB.questions(spark, d)
    return qa.competition_dataset(qs, TB.truths(qs), TB.corpus(spark, d), order_col="filename", on_missing="fail")

_CONTEXTS = """refs AS (SELECT qid, category, unnest(source) AS doc_num, unnest(range(len(source))) AS pos FROM questions WHERE len(source) > 0),
ctx AS (
  SELECT r.qid, string_agg('<article id="' || r.category || '_' || CAST(r.doc_num AS VARCHAR) || '">' || c.content || '</article>', '' ORDER BY pos) AS context
  FROM refs r JOIN lookup c ON c.category = r.category AND c.doc_num = r.doc_num GROUP BY r.qid)"""


@register("context_two_truths", O.with_(O.QUESTIONS, "lookup AS (SELECT lang AS category, doc_id AS doc_num, text AS content FROM documents)",
                                        _CONTEXTS) + """
SELECT q.qid, translate(q.query, '「」', '『』') AS question, q.category, ctx.context,
       q.category || '_' || CAST(q.source[i] AS VARCHAR) AS answer_in_articleid
FROM (SELECT *, unnest([1, len(source)]) AS i FROM questions WHERE len(source) > 0) q JOIN ctx USING (qid)""")
def context_two_truths(spark, d):
    """J2 with two truths for each question (its first and last candidate):
    two rows with the same context."""
    qs = TB.questions(spark, d)
    truths = (qs.where(F.size("source") > 0)
              .select("qid", "category", F.explode(F.array(F.get("source", F.lit(0)), F.element_at("source", -1))).alias("retrieve"),
                      F.lit(None).cast("string").alias("generate")))
    return qa.competition_dataset(qs, truths, TB.corpus(spark, d), order_col="filename")


_PAGE_KEYS = """keyed AS (SELECT CASE page_id % 2 WHEN 0 THEN 'finance' ELSE 'insurance' END AS category, page_id // 5 AS doc_num, html AS content, page_id FROM pages)"""


@register("context_first_match", O.with_(_PAGE_KEYS, """lookup AS (
  SELECT category, doc_num, arg_min(content, page_id) AS content FROM keyed GROUP BY category, doc_num),
questions AS (SELECT doc_num // 4 AS qid, category, list(DISTINCT doc_num ORDER BY doc_num DESC) AS source FROM keyed WHERE category = 'finance' GROUP BY 1, 2)""",
                                         _CONTEXTS) + "SELECT q.qid, q.category, ctx.context FROM questions q JOIN ctx USING (qid)")
def context_first_match(spark, d):
    """J3 on repeated corpus keys: pages keyed by (parity, id div 5), so two or
    three to a key; of these the first by page id is the article."""
    keyed = TB.table(spark, d, "pages").select(
        F.when(F.col("page_id") % 2 == 0, "finance").otherwise("insurance").alias("category"),
        F.floor(F.col("page_id") / 5).alias("doc_num"), F.col("html").alias("content"), "page_id")
    qs = (keyed.where("category = 'finance'").groupBy(F.floor(F.col("doc_num") / 4).alias("qid"), "category")
          .agg(F.sort_array(F.collect_set("doc_num"), asc=False).alias("source")))
    return qa.assemble_context(qs, keyed, "page_id").select("qid", "category", "context")


# ---------------------------------------------------------------- QA variants

@register("qa_join", O.with_(O.QUESTIONS) + """
SELECT questions.qid, translate(questions.query, '「」', '『』') AS question, questions.category,
       questions.source, truths.retrieve
FROM questions JOIN truths USING (qid, category)""")
def qa_join(spark, d):
    qs = TB.questions(spark, d)
    out = qa.competition_dataset(qs, TB.truths(qs))
    return out.withColumnRenamed("query", "question").select("qid", "question", "category", "source", "retrieve")


@register("missing_references", O.with_(O.QUESTIONS, """shifted AS (
  SELECT qid, category, list_transform(source, lambda x: x + 1) AS source FROM questions),
refs AS (SELECT qid, category, unnest(range(len(source))) AS pos, unnest(source) AS doc_num FROM shifted)""") + """
SELECT r.qid, r.category, r.pos, r.doc_num FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = r.category AND d.doc_id = r.doc_num)""")
def missing_references(spark, d):
    qs = TB.questions(spark, d).withColumn("source", F.transform("source", lambda x: x + 1))
    out = qa.missing_references(qs, TB.corpus(spark, d))
    return out.select("qid", "category", F.col("pos").cast("long"), "doc_num")

# ---------------------------------------------------------------- prompts

@register("prompt_render", O.with_(O.QUESTIONS) + f"""
SELECT qid, {_sql_strip("'問題：「' || translate(query, '「」', '『』') || '」這個問題可以在什麼編號的參考資料中找到答案？' || " + NL + " || '參考資料：'")} AS prompt
FROM questions""")
def prompt_render(spark, d):
    qs = qa.prepare_questions(TB.questions(spark, d)).withColumnRenamed("query", "question")
    return fe.render_question(qs, task="find_id").select("qid", "prompt")


@register("chat_render", f"""SELECT conv_id,
  regexp_replace(string_agg('<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL}, '' ORDER BY turn)
                 || '<|im_start|>assistant' || {NL},
                 '\\Q<|im_start|>system' || {NL} || '\\E[^<]*\\Q<|im_end|>' || {NL} || '\\E', '', 'g') AS chat
FROM conversations GROUP BY conv_id""")
def chat_render(spark, d):
    msgs = fe.conversation_messages(TB.table(spark, d, "conversations"))
    chat = fe.render_chat(F.col("messages"), add_generation_prompt=True)
    return msgs.select("conv_id", fe.strip_header(chat, "<|im_start|>system\n", "<|im_end|>\n", "[^<]*").alias("chat"))

# ---------------------------------------------------------------- QA features

FEAT_MAX_LEN, FEAT_OVERLAP = 512, 30
SQL_PROMPT = ("'問題：「' || translate(query, '「」', '『』') || '」這個問題可以在什麼編號的參考資料中找到答案？' || "
              + NL + " || '參考資料：'")


QA_FEATURES_SQL = O.with_(O.QUESTIONS, """qa AS (
  SELECT questions.qid, questions.query, questions.category, questions.source, truths.retrieve
  FROM questions JOIN truths USING (qid, category)),
refs AS (SELECT qid, category, unnest(source) AS doc_num, unnest(range(len(source))) AS pos FROM qa),
pieces AS (
  SELECT r.qid, r.pos, '<article id="' || r.category || '_' || CAST(r.doc_num AS VARCHAR) || '">' || d.text || '</article>' AS piece
  FROM refs r JOIN documents d ON d.lang = r.category AND d.doc_id = r.doc_num),
ctx AS (SELECT qid, string_agg(piece, '' ORDER BY pos) AS context FROM pieces GROUP BY qid)""", f"""ex AS (
  SELECT qa.qid, row_number() OVER (ORDER BY qa.qid) - 1 AS ovf,
         string_split({_sql_strip(SQL_PROMPT)}, '') AS ptok,
         string_split('<context>' || coalesce(ctx.context, '') || '</context>', '') AS ctok,
         string_split(qa.category || '_' || CAST(qa.retrieve AS VARCHAR), '') AS target
  FROM qa LEFT JOIN ctx USING (qid)),
s AS (SELECT *, {FEAT_MAX_LEN} - len(ptok) AS w FROM ex),
c AS (
  SELECT qid, ovf, ptok, ctok, target, w,
         unnest(range(0, CAST(ceil(greatest(len(ctok) - w, 0) / (w - {FEAT_OVERLAP})) * (w - {FEAT_OVERLAP}) AS BIGINT) + 1,
                      w - {FEAT_OVERLAP})) AS token_start
  FROM s),
k AS (SELECT qid, ovf, token_start, w, target, len(ptok) + least(w, len(ctok)) AS padded_len,
             ptok || ctok[token_start + 1 : token_start + w] AS chunk FROM c)""", f"""m AS (
  SELECT *, list_filter(range(0, len(chunk) - len(target) + 1),
                        lambda i: chunk[i + 1 : i + len(target)] = target) AS starts FROM k)""") + f"""
SELECT qid, CAST(token_start // (w - {FEAT_OVERLAP}) AS BIGINT) AS chunk_no,
       CAST(ovf AS BIGINT) AS overflow_to_sample_mapping,
       CAST(len(chunk) AS BIGINT) AS n_tokens, CAST(padded_len AS BIGINT) AS padded_len,
       CAST(list_sum(list_transform(range(padded_len), lambda i: CASE WHEN i < len(chunk) THEN 1 ELSE 0 END)) AS BIGINT) AS mask_sum,
       CAST(CASE WHEN len(starts) > 0 THEN list_min(starts) ELSE 0 END AS BIGINT) AS start_positions,
       CAST(CASE WHEN len(starts) > 0 THEN list_min(starts) + len(target) ELSE 0 END AS BIGINT) AS end_positions,
       len(starts) > 0 AS found,
       md5(array_to_string(chunk, '')) AS chunk_md5
FROM m"""


@register("qa_features", QA_FEATURES_SQL)
def qa_features(spark, d):
    """The reference's training features for the flagship QA set: character
    tokens, 512-token prompt-led windows, answer-id span labels, padding."""
    qs = TB.questions(spark, d)
    ds = qa.competition_dataset(qs, TB.truths(qs), TB.corpus(spark, d), order_col="filename", on_missing="fail")
    f = fe.build_qa_features(ds, max_length=FEAT_MAX_LEN, overlap=FEAT_OVERLAP)
    real = F.slice("input_ids", 1, F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x))
    return f.select("qid", F.col("chunk_no").cast("long"), "overflow_to_sample_mapping",
                    F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
                    "padded_len",
                    F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"),
                    "start_positions", "end_positions", "found",
                    F.md5(F.array_join(real, "")).alias("chunk_md5"))

# ---------------------------------------------------------------- folds on the QA set

@register("qa_folds", O.with_(O.QUESTIONS, """qa AS (
  SELECT questions.qid, questions.category FROM questions JOIN truths USING (qid, category)),
cls AS (SELECT category, min(qid) AS first, count(*) AS n FROM qa GROUP BY category),
off AS (SELECT category, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cls),
r AS (SELECT qid, category, row_number() OVER (PARTITION BY category ORDER BY qid) - 1 AS j FROM qa)""") + """
SELECT r.qid, r.category,
       CAST(len(list_filter(
         list_transform(range(5), lambda f: list_sum(list_transform(range(f + 1),
             lambda i: (off.off + off.n - 1 - i + 5) // 5 - (off.off - 1 - i + 5) // 5))),
         lambda c: c <= r.j)) AS INTEGER) AS fold,
       CAST(len(list_filter(
         list_transform(range(5), lambda f: list_sum(list_transform(range(f + 1),
             lambda i: (off.off + off.n - 1 - i + 5) // 5 - (off.off - 1 - i + 5) // 5))),
         lambda c: c <= r.j)) <> 0 AS BOOLEAN) AS is_train
FROM r JOIN off USING (category)""")
def qa_folds(spark, d):
    """W1 + U4 as the reference uses them: 5 stratified folds of the QA set
    (questions ⋈ truths, stratified by category, in qid order); fold 0 is
    the validation split, the rest train."""
    qs = TB.questions(spark, d)
    ds = qa.competition_dataset(qs, TB.truths(qs)).select("qid", "category")
    f = sl.stratified_folds(ds, "category", "qid", k=5)
    return f.select("qid", "category", "fold", (F.col("fold") != 0).alias("is_train"))

# ---------------------------------------------------------------- inference path

INFER_WIDTH = 64  # as long as the logits
_STEP = INFER_WIDTH - WINDOW_OVERLAP


@register("inference_answers", O.with_(O.LOGITS, f"""t AS (SELECT doc_id, string_split(text, ' ') AS tk FROM documents),
t2 AS (SELECT doc_id, tk[1 : (doc_id * 13) % len(tk)] || ['faq_' || CAST(doc_id AS VARCHAR)] || tk[(doc_id * 13) % len(tk) + 1 :] AS tokens FROM t),
c AS (SELECT doc_id, tokens, unnest(range(0, CAST(ceil(greatest(len(tokens) - {INFER_WIDTH}, 0) / {_STEP}) * {_STEP} AS BIGINT) + 1, {_STEP})) AS st FROM t2),
k AS (SELECT doc_id, st // {_STEP} AS chunk_no, tokens[st + 1 : st + {INFER_WIDTH}] AS chunk FROM c),
l AS (SELECT doc_id, chunk_no, chunk,
             least(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS ps,
             greatest(list_position(start_logits, list_max(start_logits)), list_position(end_logits, list_max(end_logits))) - 1 AS pe
      FROM k JOIN logits ON vec_id = (doc_id * 31 + chunk_no) % (SELECT count(*) FROM embeddings)),
a AS (SELECT doc_id, chunk_no, chunk, ps, pe, unnest(range(6)) AS w FROM l),
tried AS (
  SELECT doc_id, chunk_no, w * 5 AS incre,
         regexp_extract(array_to_string(chunk[greatest(ps - 5 * w * (w + 1) // 2, 0) + 1 : least(pe + 5 * w * (w + 1) // 2, len(chunk) - 1) + 1], ' '),
                        '(?:insurance|finance|faq)_[0-9]+') AS m FROM a),
best AS (SELECT doc_id, chunk_no, arg_min(m, incre) AS m FROM tried WHERE m <> '' GROUP BY doc_id, chunk_no)""") + """
SELECT DISTINCT CAST(doc_id AS INTEGER) AS qid, CAST(split_part(m, '_', 2) AS INTEGER) AS retrieve FROM best""")
def inference_answers(spark, d):
    """The inference path after the model (F26 F28 W4 F16 F17 P15 A2 P11):
    64-token windows of each document, into which its id was planted; the
    window's start and end logits (``embeddings``) → argmax spans, swapped →
    widening search for a document id in the window → best (least widened)
    prediction per (qid, category, retrieve) → answers."""
    n = TB.table(spark, d, "embeddings").select(F.count(F.lit(1))).scalar()
    # a window's spans are two numbers each: these go to the texts, and no window is shuffled
    spans = dc.decode(TB.logits(spark, d).select("vec_id", "start_logits", "end_logits"), confidence=False)
    spans = spans.groupBy("vec_id").agg(F.collect_list(F.struct("pred_start", "pred_end")).alias("spans"))
    docs = TB.table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    docs = docs.repartition(range_partitions(docs), "doc_id")  # the texts move once: both uses and the join are by doc_id
    windows = planted(docs).groupBy("doc_id").agg(F.max(F.size(fe.window_starts(F.size("tokens"), INFER_WIDTH, WINDOW_OVERLAP))).alias("n"))
    numbers = windows.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    listed = (numbers.withColumn("vec_id", (F.col("doc_id") * 31 + F.col("chunk_no")) % n).join(spans, "vec_id", "left")
              .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "spans"))).alias("spans"))
              .select("doc_id", F.transform("spans", lambda x: x["spans"]).alias("spans")))
    tokens = planted(docs.join(listed, "doc_id"), "spans").select("doc_id", "spans", "tokens")
    scored = (fe.token_windows(tokens, "tokens", width=INFER_WIDTH, overlap=WINDOW_OVERLAP, along="spans")
              .select("doc_id", "chunk_no", "chunk", F.inline("spans")))
    preds = dc.widening_search(scored, tokens="chunk")
    return co.collect_answers(preds.select(F.col("doc_id").alias("qid"), F.col("category_pred").alias("category"), "retrieve", "incre_num_by"))
