"""Registered queries: corpus building (file names, fallback, FAQ, union, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as cp
from . import oracle as O
from . import tables as TB
from .common import NL, _sql_strip, _sql_junk
from .registry import register


# ---------------------------------------------------------------- corpus

@register("corpus_filename_parse", O.with_(O.CORPUS) + """
SELECT filename, split_part(filename, '_', 1) AS category,
       CAST(string_split(replace(filename, '.pdf', ''), '_')[-1] AS BIGINT) AS doc_num,
       content_len
FROM corpus""")
def corpus_filename_parse(spark, d):
    c = TB.corpus(spark, d).select("filename", "content")
    out = cp.with_content_len(cp.parse_filename(c))
    return out.select("filename", "category", "doc_num", F.col("content_len").cast("long"))


FALLBACK_BLOCKLIST = ["en_1.pdf", "fr_0.pdf"]
PAGE_STEM_RE = "/(en|fr|de|es)/([0-9]+)"


def page_fallback(spark, d):
    """pages → fallback texts keyed by file stem (lang_number from the url);
    the first page (by page_id) wins for a repeated stem."""
    p = TB.table(spark, d, "pages")
    stem = F.concat(F.regexp_extract("url", PAGE_STEM_RE, 1), F.lit("_"), F.regexp_extract("url", PAGE_STEM_RE, 2))
    return (p.where(F.regexp_extract("url", PAGE_STEM_RE, 2) != "")
            .groupBy(stem.alias("stem")).agg(F.min_by("html", "page_id").alias("text")))


@register("corpus_fallback", O.with_(O.CORPUS, f"""fb AS (
  SELECT regexp_extract(url, '{PAGE_STEM_RE}', 1) || '_' || regexp_extract(url, '{PAGE_STEM_RE}', 2) AS stem,
         min_by(html, page_id) AS text
  FROM pages WHERE regexp_extract(url, '{PAGE_STEM_RE}', 2) <> '' GROUP BY 1),
j AS (
  SELECT c.*, fb.text AS fb_text,
         (c.content_len < 50 OR c.filename IN ({', '.join(repr(x) for x in FALLBACK_BLOCKLIST)})) AS low
  FROM corpus c LEFT JOIN fb ON fb.stem = regexp_replace(c.filename, '\\.[^.]*$', ''))""") + f"""
SELECT filename, category,
       CASE WHEN low AND fb_text IS NOT NULL THEN '<page number="0">' || {_sql_junk('fb_text')} || '</page>' ELSE content END AS content,
       CAST(length(CASE WHEN low AND fb_text IS NOT NULL THEN '<page number="0">' || {_sql_junk('fb_text')} || '</page>' ELSE content END) AS BIGINT) AS content_len,
       doc_num
FROM j""")
def corpus_fallback(spark, d):
    out = cp.apply_fallback(TB.corpus(spark, d), page_fallback(spark, d), min_len=50,
                            blocklist=FALLBACK_BLOCKLIST, missing="keep")
    return out.withColumn("content_len", F.col("content_len").cast("long"))


FAQ_SQL = f"""t AS (
  SELECT conv_id, turn, role, text,
         max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rec
  FROM conversations),
r AS (
  SELECT conv_id AS faqid, rec, max(CASE WHEN role = 'user' THEN text END) AS question,
         list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS answers
  FROM t WHERE rec IS NOT NULL GROUP BY conv_id, rec),
r2 AS (
  SELECT faqid, rec, question,
         CASE WHEN answers IS NULL OR len(answers) = 0 THEN NULL WHEN len(answers) = 1 THEN answers[1]
              ELSE array_to_string(answers[1:len(answers) - 1], '、') || '及' || answers[len(answers)] END AS a
  FROM r),
faq AS (
  SELECT 'faq' AS category,
         '{cp.FAQ_QUESTION_PREFIX}' || coalesce(string_agg(question, {NL} ORDER BY rec), '') ||
         '{cp.FAQ_ANSWER_PREFIX}' || coalesce(string_agg(a, {NL} ORDER BY rec), '') AS content,
         faqid AS doc_num
  FROM r2 GROUP BY faqid)"""


def faq_corpus_df(spark, d):
    recs = cp.faq_records(TB.table(spark, d, "conversations"))
    return cp.faq_to_corpus(recs)


@register("faq_corpus", O.with_(FAQ_SQL) +
          "SELECT category, content, CAST(length(content) AS BIGINT) AS content_len, doc_num FROM faq")
def faq_corpus(spark, d):
    return faq_corpus_df(spark, d).withColumn("content_len", F.col("content_len").cast("long"))


@register("corpus_union", O.with_(O.CORPUS, FAQ_SQL) + """
SELECT filename, category, content, content_len, doc_num FROM corpus
UNION ALL
SELECT NULL AS filename, category, content, CAST(length(content) AS BIGINT) AS content_len, doc_num FROM faq""")
def corpus_union(spark, d):
    c = TB.corpus(spark, d).withColumn("content_len", F.col("content_len").cast("long"))
    f = faq_corpus(spark, d)
    return cp.union_corpora(c, f).select("filename", "category", "content", "content_len", "doc_num")


@register("page_markup", f"""SELECT conv_id AS doc_id,
  string_agg(CASE WHEN {_sql_strip('text')} <> '' THEN '<page number="' || CAST(turn AS VARCHAR) || '">' || {_sql_strip('text')} || '</page>' END, '' ORDER BY turn) AS content
FROM conversations GROUP BY conv_id""")
def page_markup(spark, d):
    pages = TB.table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return cp.pages_to_document(pages)
