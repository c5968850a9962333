"""op1: language-model scores of the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import score_texts
from .registry import register
from .tables import crc_bucket, table


@register("op1_lattice_score")
def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket(F.col("id"), 7) != 2)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
