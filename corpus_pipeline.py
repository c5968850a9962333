"""The corpus pipeline: rejected documents go, one document of each group of
near-duplicates stays, contaminated documents go, personal data is masked, and
what is left is encoded.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; it works on all that the
stage before kept, and all but the last return the columns of ``documents``.
Stages take null ids and texts, repeated rows, empty tables and further columns
as their operators define (see docloom/llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontaminate import clean_documents
from docloom.llm.jaccard import one_of_each
from docloom.llm.lexicon import run_words
from docloom.llm.pii import redact
from docloom.llm.quality import accepted_documents
from docloom.llm.sentencepiece import encode
from docloom.llm.tables import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer accepts."""
    return accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, ``n_chars`` to match."""
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of each document."""
    return encode(docs, words=run_words).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pii", pii),
          ("pieces", pieces)]

#: SQL can't express the quality and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
