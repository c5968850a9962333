"""op10: licences of the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import COPYRIGHT_LINE, KNOWN, OTHER, SPELLINGS, known_licenses, scan_licenses
from .registry import register
from .tables import LOWER, UPPER, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    x = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    x = f"regexp_replace({x}, {_quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
    x = f"' ' || replace(regexp_replace({x}, {_quoted(OTHER)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in SPELLINGS.items():
        x = f"replace({x}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


def _whole_sql(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"


SQL = f"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}),
lic AS (SELECT DISTINCT license, c FROM (SELECT license, {_whole_sql(_canonical_sql("text"))} AS c FROM known) WHERE c <> ''),
doc AS (SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents),
line AS (SELECT doc_id, {_whole_sql("l")} AS c FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS l FROM doc)),
found AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS ids FROM line JOIN lic USING (c) GROUP BY doc_id),
fst AS (SELECT c, min(license) AS license FROM lic GROUP BY c)
SELECT d.doc_id, sha256(d.c) AS digest, fst.license, coalesce(ids, '') AS line_licenses
FROM (SELECT doc_id, {_whole_sql("lines")} AS c FROM doc) d LEFT JOIN fst USING (c) LEFT JOIN found USING (doc_id)
"""


@register("op10_licenses", SQL)
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), known_licenses(spark))
    return found.withColumn("line_licenses", F.concat_ws(",", "line_licenses"))
