"""op6: benchmark decontamination of the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_windows, contaminated, find_hits
from .registry import register
from .tables import LOWER, UPPER, table

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM dwin JOIN win USING (k, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
               array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op6_decontaminate", SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"),
                     benchmark_windows(table(spark, sf_dir, "benchmark")))
    return hits.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                       contaminated().alias("contaminated"))
