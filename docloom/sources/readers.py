"""Readers (S1, S4-S8): explicit schemas, no inference pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from . import json_ranges

EXCLUDE_MARKER = "pred_retrieve"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus Parquet scan (filters and projections push down)."""
    return spark.read.schema(S.CORPUS).parquet(path)


def read_wrapped_json(spark: SparkSession, path: str, root: str, elem: T.StructType) -> DataFrame:
    """``{"<root>": [ {...}, ... ]}`` files → one row per element.

    Each file is read by one task; ``json_ranges.read_json_document`` reads a
    large one by many, and ``read_json_lines`` one element per line."""
    schema = T.StructType([T.StructField(root, T.ArrayType(elem))])
    return (spark.read.schema(schema).option("multiLine", True).json(path)
            .select(F.inline(F.col(root))))


def read_json_lines(spark: SparkSession, path: str, elem: T.StructType) -> DataFrame:
    """S4 scalable form: JSON lines, splittable."""
    return spark.read.schema(elem).json(path)


def read_wrapped_lines(spark: SparkSession, path: str, root: str, elem: T.StructType) -> DataFrame:
    """S4 for documents of ``sinks.write_wrapped_json``: the frame is taken off
    each line, so the folder is read in parallel.  The document's end is a line
    of its own."""
    body = F.regexp_replace("value", r"^(\{\"" + root + r"\": \[|,)", "")
    return (spark.read.text(path).select(body.alias("value")).where((F.length("value") > 0) & (F.col("value") != "]}"))
            .select(F.from_json("value", elem).alias("r")).select("r.*"))


def read_questions(spark: SparkSession, path: str, parallel: bool = False) -> DataFrame:
    """S4; ``parallel``: each document by as many tasks as it has byte ranges."""
    return _wrapped(parallel)(spark, path, "questions", S.QUESTION)


def read_truths(spark: SparkSession, path: str, parallel: bool = False) -> DataFrame:
    """S4; ``parallel``: each document by as many tasks as it has byte ranges."""
    return _wrapped(parallel)(spark, path, "ground_truths", S.TRUTH)


def _wrapped(parallel: bool) -> Callable[..., DataFrame]:
    return json_ranges.read_json_document if parallel else read_wrapped_json


def read_faq_map(spark: SparkSession, path: str, parallel: bool = False) -> DataFrame:
    """One JSON object ``id → [ {question, answers[]} ]`` per file →
    ``(faqid bigint, rec int, question, answers)``; the key is cast strictly.
    ``parallel``: each file by as many tasks as it has byte ranges."""
    if parallel:
        return json_ranges.read_id_map(spark, path)
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", S.FAQ_MAP)).alias("k", "recs"))
    return m.select(F.col("k").cast("long").alias("faqid"),
                    F.posexplode("recs").alias("rec", "r")) \
        .select("faqid", "rec", F.col("r.question").alias("question"), F.col("r.answers").alias("answers"))


def read_predictions(spark: SparkSession, path: str, checkpoint: int | None = None,
                     stream: bool = False, json_lines: bool = False,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Prediction files named ``qid…checkpoint{n}.json`` (JSON arrays,
    or JSON lines with ``json_lines``) → rows plus ``checkpoint`` parsed from
    the file name (or a ``checkpoint=n`` folder).  Files whose name contains
    ``pred_retrieve`` are skipped; the name test is anchored (Q9).  Works as
    a batch read or as a file-source stream (then writers must add files
    atomically under new names)."""
    r = spark.readStream if stream else spark.read
    r = r.schema(S.PREDICTION).option("pathGlobFilter", "*.{json,txt}").option("recursiveFileLookup", True)
    if not json_lines:
        r = r.option("multiLine", True)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.json(path)
    name = F.col("_metadata.file_name")
    fpath = F.col("_metadata.file_path")
    # the file's name, or that of its folder where a sink made the folder the file
    own = F.coalesce(F.nullif(F.regexp_extract(fpath, r"/file=(qid[^/]+\.json)/[^/]+$", 1), F.lit("")), name)
    ck = F.regexp_extract(own, r"^qid.+checkpoint([0-9]+)\.json$", 1)
    ck = F.when(ck != "", ck).otherwise(
        F.nullif(F.regexp_extract(fpath, r"/checkpoint=([0-9]+)/", 1), F.lit("")))
    out = (df.withColumn("checkpoint", ck.cast("int"))
           .where(~name.contains(EXCLUDE_MARKER) & F.col("checkpoint").isNotNull()))
    if checkpoint is not None:
        out = out.where(F.col("checkpoint") == checkpoint)
    return out


def read_text_fallback(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One text file per document → ``(stem, text)``."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"),
                     F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """S7 input: ``binaryFile`` scan → (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", True).load(path)


def file_name_parts(df: DataFrame, path_col: str = "path") -> DataFrame:
    """P4 on a path column: ``filename``, ``category`` and ``doc_num``."""
    fn = F.element_at(F.split(F.col(path_col), "/"), -1)
    stem = F.regexp_replace(fn, r"\.[^.]*$", "")
    return (df.withColumn("filename", fn)
            .withColumn("category", F.get(F.split(fn, "_"), 0))
            .withColumn("doc_num", F.element_at(F.split(stem, "_"), -1).cast("long")))


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object of arguments → one row ``(run_id, config map)``."""
    from ..operators.trials import run_id
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,string>")
    return raw.select(run_id(m).alias("run_id"), m.alias("config"))
