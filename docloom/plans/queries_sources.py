"""Registered queries that write a given table and read it back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import corpus as cp
from ..session import fresh_dir, materialized
from ..sources import json_ranges as jr
from ..sources import readers as rd
from ..sources import sinks as sk
from . import oracle as O
from . import tables as TB
from .queries_corpus import FAQ_SQL
from .registry import register


@register("prediction_file_names", O.with_(O.PREDICTIONS) + """
SELECT 'qid' || qid // 64 || '_iter' || qid % 3 || '_checkpoint' || checkpoint || '.json' AS file, count(*) AS n,
       CAST(sum(incre_num_by) AS BIGINT) AS total FROM preds WHERE qid IS NOT NULL GROUP BY file""")
def prediction_file_names(spark, d):
    """The prediction files under their very names, and what each holds."""
    preds = TB.predictions(spark, d).where("qid IS NOT NULL").withColumn("batch", F.floor(F.col("qid") / 64)).withColumn("iteration", F.col("qid") % 3)
    path = fresh_dir(spark, "prediction-names")
    sk.write_named_predictions(preds, path, qid="batch")
    return (spark.read.schema(S.PREDICTION).option("multiLine", True).json(path)
            .groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("incre_num_by").alias("total")))


@register("answer_file", "SELECT conv_id, turn, text FROM conversations")
def answer_file(spark, d):
    """One wrapped document as one file of a given name."""
    turns = TB.table(spark, d, "conversations").select("conv_id", "turn", "text")
    path = fresh_dir(spark, "answer-file")
    sk.write_answer_file(turns, path, "pred_retrieve_120.json", "answers", ["conv_id", "turn"])
    return materialized(rd.read_wrapped_json(spark, f"{path}/pred_retrieve_120.json", "answers", turns.schema), "answer-file-read")


FAQ_MAP_SQL = O.with_(FAQ_SQL) + """
SELECT faqid, CAST(row_number() OVER (PARTITION BY faqid ORDER BY rec) - 1 AS INTEGER) AS rec, question,
       CAST(coalesce(len(answers), 0) AS INTEGER) AS n_answers, md5(coalesce(array_to_string(answers, '|'), '')) AS answers_md5 FROM r"""


@register("corpus_roundtrip", O.with_(O.CORPUS) + "SELECT filename, category, md5(content) AS content_md5, content_len, doc_num FROM corpus")
def corpus_roundtrip(spark, d):
    """The corpus written, read with its schema, and built or loaded
    twice: the second call loads what the first one built."""
    path = fresh_dir(spark, "corpus")
    sk.write_corpus(TB.corpus(spark, d), path)
    built = fresh_dir(spark, "corpus-built")
    sk.materialize(spark, lambda: rd.read_corpus(spark, path), built)
    loaded = sk.materialize(spark, lambda: rd.read_corpus(spark, path).where("false"), built)
    return loaded.select("filename", "category", F.md5(F.col("content").cast("binary")).alias("content_md5"),
                         F.col("content_len").cast("long").alias("content_len"), "doc_num")


@register("wrapped_json_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def wrapped_json_roundtrip(spark, d):
    """One wrapped document written by all tasks, read in parallel."""
    turns = TB.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = fresh_dir(spark, "wrapped")
    sk.write_wrapped_json(turns, path, "turns", ["conv_id", "turn"])
    return rd.read_wrapped_lines(spark, path, "turns", turns.schema)


@contextmanager
def _ranges(spark, size):
    """Files are read in byte ranges of about ``size``."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@register("wrapped_document_ranges", "SELECT conv_id, turn, role, [text, role] AS lines FROM conversations")
def wrapped_document_ranges(spark, d):
    """Documents ``{"turns": [...]}`` of 2,000 conversations each, every one
    on a single line, read in byte ranges of 128 KB."""
    turns = TB.table(spark, d, "conversations").select("conv_id", "turn", "role", F.array("text", "role").alias("lines"))
    path = fresh_dir(spark, "wrapped-document")
    (turns.groupBy(F.floor(F.col("conv_id") / 2000).alias("part")).agg(F.collect_list(F.struct("conv_id", "turn", "role", "lines")).alias("turns"))
     .select("part", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("value")).repartition("part")
     .write.mode("append").partitionBy("part").text(path))
    with _ranges(spark, 128 << 10):
        return materialized(jr.read_json_document(spark, path, "turns", turns.schema), "wrapped-ranges")


@register("json_lines_roundtrip", "SELECT item_id, text FROM benchmark")
def json_lines_roundtrip(spark, d):
    """Sorted JSON lines and back."""
    items = TB.table(spark, d, "benchmark").select("item_id", "text")
    path = fresh_dir(spark, "lines")
    sk.write_sorted_json_lines(items, path, ["item_id"])
    return rd.read_json_lines(spark, path, items.schema)


@register("prediction_files_roundtrip", O.with_(O.PREDICTIONS) + "SELECT qid, category, retrieve, incre_num_by, checkpoint FROM preds")
def prediction_files_roundtrip(spark, d):
    """JSON-array files ``qid{q}_iter{i}_checkpoint{n}.json``, one
    for each batch of 64 question ids and checkpoint, read back with the
    checkpoint from the name."""
    preds = TB.predictions(spark, d).withColumn("batch", F.floor(F.col("qid") / 64)).withColumn("iteration", F.lit(0))
    path = fresh_dir(spark, "prediction-files")
    sk.write_prediction_files(preds, path, qid="batch")
    return rd.read_predictions(spark, path).select("qid", "category", "retrieve", "incre_num_by", "checkpoint")


@register("faq_map_roundtrip", FAQ_MAP_SQL)
def faq_map_roundtrip(spark, d):
    """FAQ records as JSON objects ``id → records``, 64 ids to a file, and back."""
    recs = cp.faq_records(TB.table(spark, d, "conversations"))
    lists = (recs.groupBy("faqid").agg(F.sort_array(F.collect_list(F.struct("rec", F.struct("question", "answers").alias("r")))).alias("l"))
             .select("faqid", F.transform("l", lambda x: x["r"]).alias("l")))
    maps = (lists.groupBy(F.floor(F.col("faqid") / 64).alias("part")).agg(F.collect_list(F.struct(F.col("faqid").cast("string").alias("k"), "l")).alias("e"))
            .select("part", F.to_json(F.map_from_entries("e")).alias("value")))
    path = fresh_dir(spark, "faq-map")
    maps.repartition("part").write.mode("append").partitionBy("part").text(path)
    return _faq_digest(rd.read_faq_map(spark, path))


def _faq_digest(back):
    return back.select("faqid", F.col("rec").cast("int").alias("rec"), "question",
                       F.coalesce(F.size(F.coalesce("answers", F.array().cast(T.ArrayType(T.StringType())))), F.lit(0)).alias("n_answers"),
                       F.md5(F.coalesce(F.array_join("answers", "|"), F.lit("")).cast("binary")).alias("answers_md5"))


@register("faq_map_ranges", FAQ_MAP_SQL)
def faq_map_ranges(spark, d):
    """FAQ records as JSON objects ``id → records``, 2,000 ids to a file,
    each on a single line, read in byte ranges of 128 KB."""
    recs = cp.faq_records(TB.table(spark, d, "conversations"))
    lists = (recs.groupBy("faqid").agg(F.sort_array(F.collect_list(F.struct("rec", F.struct("question", "answers").alias("r")))).alias("l"))
             .select("faqid", F.transform("l", lambda x: x["r"]).alias("l")))
    maps = (lists.groupBy(F.floor(F.col("faqid") / 2000).alias("part")).agg(F.collect_list(F.struct(F.col("faqid").cast("string").alias("k"), "l")).alias("e"))
            .select("part", F.to_json(F.map_from_entries("e")).alias("value")))
    path = fresh_dir(spark, "faq-ranges")
    maps.repartition("part").write.mode("append").partitionBy("part").text(path)
    with _ranges(spark, 128 << 10):
        back = materialized(rd.read_faq_map(spark, path, parallel=True), "faq-ranges-read")
    return _faq_digest(back)


@register("write_once", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def write_once(spark, d):
    """What is there stays: the second write changes nothing."""
    counts = TB.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    path = fresh_dir(spark, "once") + "/metrics"
    sk.write_once(counts, path)
    sk.write_once(counts.withColumn("n", F.lit(0).cast("long")), path)
    return spark.read.schema(counts.schema).json(path)
