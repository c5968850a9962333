"""op9: toxicity of the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register
from .tables import crc_bucket, table
from .toxicity import fit, score


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    return (score(docs, fit(docs, labels, ~held_out))
            .select(F.col("row.doc_id").alias("doc_id"), "score")
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
