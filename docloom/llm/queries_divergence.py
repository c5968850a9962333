"""op13: how the sources of the whole ``documents`` table differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .divergence import audit
from .registry import register
from .tables import LOWER, UPPER, table

SQL = f"""
WITH doc AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM doc) GROUP BY lang, t HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
occ AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM doc) JOIN kept USING (lang, t) GROUP BY lang, source, t),
tot AS (SELECT lang, source, sum(n) AS total FROM occ GROUP BY lang, source),
cell AS (SELECT g.lang, g.source, k.t, coalesce(o.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (coalesce(tot.total, 0) + 5 * v.v)::HUGEINT AS p
         FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN occ o USING (lang, source, t) LEFT JOIN tot USING (lang, source)),
al AS (SELECT lang, t, sum(n) AS n FROM occ GROUP BY lang, t),
altot AS (SELECT lang, sum(n) AS total FROM al GROUP BY lang),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS q FROM al JOIN altot USING (lang) JOIN v USING (lang)),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM cell a JOIN cell b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN dist d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, CAST(p - q AS BIGINT) AS value FROM cell JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 50
"""


@register("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
