"""Registered queries: text cleaning functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from . import tables as TB
from .common import SQL_CJK, SQL_NOISY, _sql_blank_lines, _sql_fold, _sql_fixpoint, _sql_junk, _sql_clean, noisy_cjk, _docs, _sql_despace_once
from .registry import register


# ---------------------------------------------------------------- text cleaning

@register("despace_once", f"SELECT doc_id, {_sql_despace_once(SQL_CJK)} AS text FROM documents")
def despace_once(spark, d):
    return _docs(spark, d).select("doc_id", tx.despace_cjk_once(TB.cjk_text()).alias("text"))


@register("despace_fixpoint", f"SELECT doc_id, {_sql_fixpoint(SQL_CJK)} AS text FROM documents")
def despace_fixpoint(spark, d):
    return _docs(spark, d).select("doc_id", tx.despace_cjk(TB.cjk_text()).alias("text"))


@register("drop_blank_lines", f"SELECT doc_id, {_sql_blank_lines(SQL_NOISY)} AS text FROM documents")
def drop_blank_lines(spark, d):
    return _docs(spark, d).select("doc_id", tx.drop_blank_lines(noisy_cjk()).alias("text"))


@register("fold_brackets", f"SELECT doc_id, {_sql_fold(SQL_NOISY)} AS text FROM documents")
def fold_brackets(spark, d):
    return _docs(spark, d).select("doc_id", tx.fold_brackets(noisy_cjk()).alias("text"))


@register("junk_removal", f"SELECT doc_id, {_sql_junk(SQL_CJK)} AS text FROM documents")
def junk_removal(spark, d):
    return _docs(spark, d).select("doc_id", tx.remove_junk(TB.cjk_text()).alias("text"))


@register("clean_text", f"SELECT doc_id, {_sql_clean(SQL_NOISY)} AS text FROM documents")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.clean_text(noisy_cjk()).alias("text"))


@register("list_join", f"""WITH w AS (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)
SELECT doc_id, CASE WHEN len(parts) = 0 THEN NULL WHEN len(parts) = 1 THEN parts[1]
  ELSE array_to_string(parts[1:len(parts) - 1], '{tx.LIST_SEPARATOR}') || '{tx.LIST_LAST_SEPARATOR}' || parts[len(parts)] END AS joined
FROM w""")
def list_join(spark, d):
    """F11 over every sentence of every document (whole texts)."""
    parts = F.split("text", r"\. ")
    return _docs(spark, d, balanced=False).select("doc_id", tx.join_cjk_list(parts).alias("joined"))


@register("doc_id_extract", """WITH t AS (
  SELECT doc_id, regexp_extract_all(replace(text, '. ', '. finance_' || CAST(doc_id AS VARCHAR) || ' '),
                                    '(?:insurance|finance|faq)_[0-9]+') AS ids FROM documents)
SELECT doc_id, split_part(ids[1], '_', 1) AS category, split_part(ids[1], '_', 2) AS retrieve,
       CAST(len(ids) AS BIGINT) AS n_ids
FROM t WHERE len(ids) > 0""")
def doc_id_extract(spark, d):
    planted = F.replace(F.col("text"), F.lit(". "),
                        F.concat(F.lit(". finance_"), F.col("doc_id").cast("string"), F.lit(" ")))
    ids = tx.extract_doc_ids(planted)
    return (_docs(spark, d).select("doc_id", ids.alias("_ids"))
            .where(F.size("_ids") > 0)
            .select("doc_id", tx.split_doc_id(F.get(F.col("_ids"), 0))["category"].alias("category"),
                    tx.split_doc_id(F.get(F.col("_ids"), 0))["number"].alias("retrieve"),
                    F.size("_ids").cast("long").alias("n_ids")))
