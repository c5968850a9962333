"""op2: quality of the whole ``documents`` table by weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import fit, score
from .registry import register
from .tables import table


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select(F.col("row.doc_id").alias("doc_id"), "pattern", "posterior", "score",
                                         (F.col("score") >= 0.5).alias("accepted"))
