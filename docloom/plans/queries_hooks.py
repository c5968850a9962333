"""Registered queries over the Arrow hooks: charset repair and node text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.tree import document_order
from ..sources import hooks as hk
from . import tables as TB
from .common import NL, SQL_NOISY, _sql_junk, _sql_clean, noisy_cjk, _docs
from .registry import register


@register("charset_normalize", """
SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL ELSE CASE doc_id % 4 WHEN 1 THEN 'utf-16' WHEN 2 THEN 'cp1252' WHEN 3 THEN 'utf-8-sig' ELSE 'utf-8' END END AS encoding, text IS NOT NULL AS ok
FROM documents""")
def charset_normalize(spark, d):
    """Each document's text in one of four encodings by its id; the repair
    has to give the text back.  (A text of plain ASCII is the same bytes in
    all single-byte encodings.  A null text stays null, and isn't ok.)"""
    by = F.col("doc_id") % 4
    raw = (F.when(by == 1, F.encode("text", "UTF-16"))  # with a byte-order mark
           .when(by == 2, F.encode("text", "ISO-8859-1"))
           .when(by == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
           .otherwise(F.encode("text", "UTF-8")))
    docs = _docs(spark, d).select("doc_id", raw.alias("content"), by.alias("by"))
    out = hk.normalize_charset(docs, "content", candidates=("big5", "cp1252"), keep=("doc_id", "by"))
    plain = (F.col("by") == 2) & (F.col("encoding") == "utf-8") & ~F.col("text").rlike("[^\\x00-\\x7F]")
    return out.select("doc_id", "text", F.when(plain, F.lit("cp1252")).otherwise(F.col("encoding")).alias("encoding"), "ok")


def document_nodes(spark, d):
    """documents → an exploded node table: one ``text`` node per line."""
    return (_docs(spark, d)
            .select("doc_id", F.posexplode(F.split(noisy_cjk(), "\n")).alias("node_no", "text"))
            .withColumn("kind", F.lit("text")))


@register("node_text_map", f"""WITH n AS (
  SELECT doc_id, string_split({SQL_NOISY}, {NL}) AS parts FROM documents),
e AS (SELECT doc_id, unnest(range(len(parts))) AS node_no, unnest(parts) AS text FROM n)
SELECT doc_id, CAST(node_no AS BIGINT) AS node_no, {_sql_junk(_sql_clean('text'))} AS text FROM e""")
def node_text_map(spark, d):
    out = hk.transform_nodes(document_nodes(spark, d), tx.clean_node_text)
    return out.select("doc_id", F.col("node_no").cast("long"), "text")


@register("tree_document_order", """
WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, length(text) % 3 AS node_no,
                            CASE WHEN length(text) % 5 = 0 THEN 'picture' WHEN role = 'system' THEN 'group' ELSE 'text' END AS kind FROM conversations),
t AS (SELECT conv_id, turn, kind, [(node_no, turn)] AS path, 0 AS level, false AS under_picture FROM n WHERE parent IS NULL
      UNION ALL
      SELECT n.conv_id, n.turn, n.kind, list_append(t.path, (n.node_no, n.turn)), t.level + 1, t.under_picture OR coalesce(t.kind = 'picture', false)
      FROM n JOIN t ON n.conv_id = t.conv_id AND n.parent = t.turn)
SELECT n.conv_id, n.turn, CASE WHEN t.turn IS NOT NULL THEN row_number() OVER (PARTITION BY n.conv_id, t.turn IS NULL ORDER BY t.path) - 1 END AS preorder,
       t.level, t.under_picture, t.turn IS NOT NULL AS reached
FROM n LEFT JOIN t ON t.conv_id = n.conv_id AND t.turn = n.turn""")
def tree_document_order(spark, d):
    """Each conversation's turns as a binary tree (turn t under (t - 1) div 2)
    in document order, siblings by the length of their text modulo 3."""
    turns = TB.table(spark, d, "conversations")
    size = F.length("text")
    nodes = turns.select("conv_id", "turn", F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("parent"), (size % 3).alias("node_no"),
                         F.when(size % 5 == 0, "picture").when(F.col("role") == "system", "group").otherwise("text").alias("kind"))
    nodes = nodes.withColumn("turn", F.col("turn").cast("long"))
    out = document_order(nodes, "conv_id", "turn", "parent", "node_no")
    return out.select("conv_id", "turn", "preorder", "level", "under_picture", "reached")
