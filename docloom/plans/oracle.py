"""DuckDB SQL building blocks that mirror ``plans/tables.py``.

The oracle views are the driver's parquet tables; these CTEs derive the same
reference entities with plain SQL so each registered query can be checked
against an independent engine.
"""

# Fixed values (same as plans/tables.py).
LANGS_SQL = "['en','fr','de','es']"
CJK_26 = "一中文字人大小山水火木金土日月天地上下本票融資料問海"

CORPUS = """corpus AS (
  SELECT lang || '_' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename, lang AS category,
         text AS content, CAST(coalesce(length(text), 0) AS BIGINT) AS content_len, doc_id AS doc_num
  FROM documents)"""

QUESTIONS = f"""q AS (
  SELECT qid, text AS query, ({LANGS_SQL})[qid % 4 + 1] AS category
  FROM (SELECT DISTINCT doc_id // 32 AS qid FROM documents) JOIN benchmark ON item_id = qid % (SELECT count(*) FROM benchmark)),
cand AS (
  SELECT q.qid, q.category, d.doc_id
  FROM documents d JOIN q ON d.lang = q.category AND d.doc_id // 32 = q.qid),
src AS (
  SELECT qid, category, list(doc_id ORDER BY doc_id) AS source FROM cand GROUP BY qid, category),
questions AS (
  SELECT q.qid, q.query, q.category, src.source FROM q LEFT JOIN src USING (qid, category)),
truths AS (
  SELECT qid, category, source[qid % len(source) + 1] AS retrieve FROM questions WHERE len(source) > 0)"""

LOGITS = """logits AS (
  SELECT vec_id, embedding AS start_logits, list_reverse(embedding) AS end_logits,
         CAST(label AS BIGINT) AS true_start, CAST(label + vec_id % 5 AS BIGINT) AS true_end
  FROM embeddings)"""

PREDICTIONS = """preds AS (
  SELECT user_id AS qid, event_type AS category, json_extract_string(props, '$.k') AS retrieve,
         CAST((event_id % 6) * 5 AS INTEGER) AS incre_num_by,
         ([120, 480, 600])[event_id % 3 + 1] AS checkpoint
  FROM events)"""

TRIALS = """trials AS (
  SELECT p_partkey AS trial_id, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b,
         CASE WHEN p_partkey % 7 = 0 THEN 'pruned' ELSE 'complete' END AS state,
         p_name, p_brand, p_type
  FROM part)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
