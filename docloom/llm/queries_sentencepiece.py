"""op7: pieces of the whole ``documents`` table, there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import run_words
from .registry import register
from .sentencepiece import encode, piece_bytes
from .tables import table


@register("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words=run_words,
                     also={"bytes": piece_bytes(spark)})
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"),
                          F.xxhash64("ids").alias("ids_hash"), F.sha2("bytes", 256).alias("decoded_sha256"))
