"""op11: byte-level BPE of the whole ``documents`` table, there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepairs import encode, packed_ids, shared_ranks, token_bytes
from .registry import register
from .tables import table


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                     also={"packed": packed_ids, "bytes": token_bytes(shared_ranks(spark))})
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))
