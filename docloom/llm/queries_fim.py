"""op12: fill-in-middle of the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fim import fill_in_middle, restore
from .registry import register
from .tables import table

SQL = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draw AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
                ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM doc),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draw),
part AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
                array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM part
"""


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@register("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = written.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
                           F.length("middle").cast("long").alias("middle_chars"), "output")
    return restore(sizes).select("doc_id", "n", "form", "prefix_chars", "middle_chars", _digest(F.col("output")).alias("output_sha256"),
                                 _digest(F.col("restored")).alias("restored_sha256"))
