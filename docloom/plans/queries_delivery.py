"""Registered queries: study tables with commits, the outbox, files of text and
of arguments, and the small pieces around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as sp
from ..operators import features as fe
from ..operators import joins as jo
from ..operators import splits as sl
from ..operators import trials as tr
from ..session import fresh_dir
from ..sources import readers as rd
from ..sources.named_files import write_named_text
from ..sources.study import StudyTable
from ..streaming.outbox import Outbox
from . import oracle as O
from . import tables as TB
from .registry import register


@register("study_latest", O.with_(O.TRIALS) + """
SELECT 'find_id' AS study, trial_id, a, CASE WHEN trial_id % 3 = 0 THEN b + 100 ELSE b END AS b,
       CASE WHEN trial_id % 3 = 0 THEN 1 ELSE 0 END AS attempt, CASE WHEN trial_id % 3 = 0 THEN state END AS state
FROM trials WHERE trial_id % 2 = 0 OR trial_id % 3 = 0""")
def study_latest(spark, d):
    """H6: half of the trials, then a third again with a further column; an
    append that fails before its commit isn't seen."""
    t = TB.trials(spark, d).select("trial_id", "a", "b", "state")
    study = StudyTable(spark, fresh_dir(spark, "study"))
    first = t.where("trial_id % 2 = 0").drop("state").withColumn("attempt", F.lit(0))
    study.append(first, "find_id")
    study.stage(first.withColumn("b", F.lit(-1.0)), "find_id")
    study.append(t.where("trial_id % 3 = 0").withColumn("b", F.col("b") + 100).withColumn("attempt", F.lit(1)), "find_id")
    return study.read().select("study", "trial_id", "a", "b", "attempt", "state")


@register("trial_attributes", """SELECT p_partkey AS trial_id, 'team' AS contributors, 'spark' AS engine FROM part""")
def trial_attributes(spark, d):
    t = tr.with_attributes(TB.trials(spark, d), {"contributors": "team", "engine": "spark"})
    return t.select("trial_id", F.col("attrs")["contributors"].alias("contributors"), F.col("attrs")["engine"].alias("engine"))


@register("outbox_delivery", """SELECT event_id % 4 AS batch_id, event_id % 11 <> 0 AS sent,
       CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS tries, count(*) AS n,
       count(CASE WHEN event_id % 11 = 0 THEN 1 END) AS dead
FROM events GROUP BY 1, 2, 3""")
def outbox_delivery(spark, d):
    """Batches of events are delivered; one batch is put twice, and a
    second delivery finds nothing to send."""
    def receive(key, row, attempt):  # refuses an event's first try, or each, by its id
        if row["event_id"] % 11 == 0 or row["event_id"] % 7 == 0 and attempt == 1:
            raise ConnectionError(f"event {row['event_id']} refused")

    events = TB.table(spark, d, "events").select("event_id", "user_id", "event_type")
    box = Outbox(spark, fresh_dir(spark, "outbox"), "event_id long, user_id long, event_type string")
    for batch in (0, 1, 1, 2, 3):
        box.put(events.where(F.col("event_id") % 4 == batch), batch, "event_id")
    box.deliver(receive)
    box.deliver(receive)
    got = box.receipts().groupBy("batch_id", (F.col("status") == "sent").alias("sent"), "tries").agg(F.count(F.lit(1)).alias("n"))
    dead = box.dead_letters().groupBy("batch_id", F.lit(False).alias("sent"), "tries").agg(F.count(F.lit(1)).alias("dead"))
    return (got.join(dead, ["batch_id", "sent", "tries"], "left")
            .select("batch_id", "sent", "tries", "n", F.coalesce("dead", F.lit(0).cast("long")).alias("dead")))


@register("text_files_by_stem", """SELECT 'item_' || item_id AS stem, md5(text) AS text_md5 FROM benchmark WHERE text IS NOT NULL""")
def text_files_by_stem(spark, d):
    """A text file for each benchmark item, read back by its stem."""
    items = TB.table(spark, d, "benchmark").where("text IS NOT NULL")
    path = fresh_dir(spark, "texts")
    write_named_text(items, path, F.concat(F.lit("item_"), F.col("item_id"), F.lit(".txt")), "text")
    return rd.read_text_fallback(spark, path).select("stem", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("run_configs", """SELECT sha256('{"brand":"' || p_brand || '","runs":"' || CAST(count(*) AS VARCHAR) || '","size":"' || CAST(p_size AS VARCHAR) || '"}') AS run_id,
  p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(count(*) AS VARCHAR) AS runs FROM part GROUP BY p_brand, p_size""")
def run_configs(spark, d):
    """A run's arguments as a flat JSON file each, read back with run ids."""
    runs = TB.table(spark, d, "part").groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("runs"))
    config = F.to_json(F.struct(F.col("p_size").cast("string").alias("size"), F.col("runs").cast("string").alias("runs"), F.col("p_brand").alias("brand")))
    path = fresh_dir(spark, "configs")
    write_named_text(runs.select(config.alias("config")), path, F.concat(F.sha2("config", 256), F.lit(".json")), "config")
    return rd.read_run_config(spark, path).select("run_id", *[F.col("config")[k].alias(k) for k in ("brand", "size", "runs")])


@register("default_fill", """SELECT doc_id, coalesce(lang, 'zz') AS lang, coalesce(text, '') = '' AS no_text, 'none' AS answer FROM documents""")
def default_fill(spark, d):
    docs = fe.fill_defaults(TB.table(spark, d, "documents").select("doc_id", "lang", "text"), {"lang": "zz", "text": "", "answer": "none"})
    return docs.select("doc_id", "lang", (F.col("text") == "").alias("no_text"), "answer")


@register("positional_zip", """WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_no FROM benchmark),
b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS row_no FROM embeddings)
SELECT row_no, item_id, vec_id FROM a JOIN b USING (row_no)""")
def positional_zip(spark, d):
    """Items in order beside vectors in descending order."""
    items = TB.table(spark, d, "benchmark").select("item_id")
    vectors = TB.table(spark, d, "embeddings").select("vec_id", (-F.col("vec_id")).alias("place"))
    return jo.zip_by_order(items, "item_id", vectors, "place").select("row_no", "item_id", "vec_id")


@register("first_example", "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 1")
def first_example(spark, d):
    return sl.first_row(TB.table(spark, d, "documents"), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("span_id_lists", O.with_(O.LOGITS) + """
SELECT vec_id, CASE WHEN true_start <= true_end THEN array_to_string(range(true_start, true_end + 1), ',') ELSE '' END AS ids FROM logits""")
def span_id_lists(spark, d):
    """the ids of every true span."""
    return TB.logits(spark, d).select("vec_id", F.array_join(sp.span_ids("true_start", "true_end").cast("array<string>"), ",").alias("ids"))


@register("answer_labels", """SELECT item_id, string_split(text, ' ')[1] || '|' || coalesce(string_split(text, ' ')[2], '') AS labels
FROM benchmark WHERE text IS NOT NULL""")
def answer_labels(spark, d):
    """an answer in pieces becomes one list of labels."""
    words = F.split("text", " ")
    pieces = F.array(F.array(F.get(words, 0)), F.array(F.coalesce(F.get(words, 1), F.lit(""))))
    items = TB.table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", pieces.alias("pieces"))
    return fe.generative_labels(items, "pieces").select("item_id", F.array_join("labels", "|").alias("labels"))
