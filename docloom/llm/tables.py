"""Reading the given tables, and intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the cluster's shared checkpoint folder
    and read back: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n (a null key counts as '')."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
