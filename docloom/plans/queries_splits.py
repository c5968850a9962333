"""Registered queries: folds, epochs, slices and seeded batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shuffle as sh
from ..operators import splits as sl
from ..session import fresh_dir
from ..streaming.cyclic import cyclic_stream
from . import oracle as O
from . import tables as TB
from .common import _docs
from .registry import register


# ---------------------------------------------------------------- splits

KFOLD_SQL = """cls AS (SELECT lang, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY lang),
off AS (SELECT lang, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cls),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS j FROM documents),
kf AS (
  SELECT r.doc_id, r.lang AS category,
         CAST(len(list_filter(
           list_transform(range(5), lambda f: list_sum(list_transform(range(f + 1),
               lambda i: (off.off + off.n - 1 - i + 5) // 5 - (off.off - 1 - i + 5) // 5))),
           lambda c: c <= r.j)) AS INTEGER) AS fold
  FROM r JOIN off USING (lang))"""


def _kfold(spark, d):
    docs = _docs(spark, d, balanced=False).select("doc_id", F.col("lang").alias("category"))
    return sl.stratified_folds(docs, "category", "doc_id", k=5)


@register("kfold_assign", O.with_(KFOLD_SQL) + "SELECT doc_id, category, fold FROM kf")
def kfold_assign(spark, d):
    return _kfold(spark, d).select("doc_id", "category", "fold")


@register("kfold_sizes", O.with_(KFOLD_SQL) + "SELECT category, fold, count(*) AS n FROM kf GROUP BY category, fold")
def kfold_sizes(spark, d):
    return sl.class_sizes(_kfold(spark, d), ["category", "fold"])


EPOCHS = 3


@register("epoch_replay", f"""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS rn,
  (SELECT count(*) FROM benchmark) AS n FROM benchmark)
SELECT item_id, CAST(e AS BIGINT) AS epoch, CAST(e * n + rn AS BIGINT) AS step
FROM (SELECT item_id, rn, n, unnest(range({EPOCHS})) AS e FROM r)""")
def epoch_replay(spark, d):
    b = TB.table(spark, d, "benchmark").select("item_id")
    return sl.epoch_replay(b, "item_id", EPOCHS).select("item_id", "epoch", "step")


@register("slice_desc", """SELECT qid, question, CAST(position AS BIGINT) AS position FROM (
  SELECT item_id AS qid, text AS question, row_number() OVER (ORDER BY item_id DESC) - 1 AS position FROM benchmark)
WHERE position >= 5 AND position < 25""")
def slice_desc(spark, d):
    b = TB.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return sl.slice_rows(b, "qid", 5, 25, descending=True).select("qid", "question", "position")


@register("slice_then_sort", """SELECT qid, question, CAST(row_number() OVER (ORDER BY qid DESC) - 1 AS BIGINT) AS position FROM (
  SELECT item_id AS qid, text AS question, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark) WHERE p >= 5 AND p < 25""")
def slice_then_sort(spark, d):
    b = TB.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return sl.slice_then_sort(b, "qid", 5, 25, "qid").select("qid", "question", "position")


@register("hash_shuffle_batches", """WITH k AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || ':42') AS shuffle_key FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY shuffle_key) - 1 AS n FROM k)
SELECT doc_id, shuffle_key, CAST(n // 16 AS BIGINT) AS batch_no, CAST(n % 16 AS BIGINT) AS pos_in_batch FROM r""")
def hash_shuffle_batches(spark, d):
    docs = sl.seeded_shuffle(_docs(spark, d, balanced=False).select("doc_id"), "doc_id", seed=42)
    return sl.batch_numbers(docs, "shuffle_key", 16).select("doc_id", "shuffle_key", "batch_no", "pos_in_batch")


@register("cyclic_stream_replay", """
WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS row_no FROM benchmark)
SELECT row_no + e * n AS generator_step, e AS epoch, item_id, md5(text) AS text_md5 FROM r, n, unnest(range(3)) AS t(e)""")
def cyclic_stream_replay(spark, d):
    """Three epochs of the endless sequence over ``benchmark``, by a query
    that is stopped and started again after every batch of a bit more than an epoch."""
    items = TB.table(spark, d, "benchmark").select("item_id", "text")
    n = items.count()
    base = fresh_dir(spark, "cyclic")
    schema = "generator_step long, epoch long, item_id long, text string"
    for _ in range(3):
        stream = cyclic_stream(spark, items, "item_id", f"{base}/progress.json", rows_per_batch=n + n // 8 + 1, steps=3 * n)
        (stream.select("generator_step", "epoch", "item_id", "text").writeStream.format("parquet").option("path", f"{base}/steps")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    out = spark.read.schema(schema).parquet(f"{base}/steps")
    return out.select("generator_step", "epoch", "item_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# the network of ``operators/shuffle.py`` as a recursive table: one round a step
@register("shuffled_epochs", f"""WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) + 1 AS a FROM benchmark),
m AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
rows AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS x FROM benchmark),
w AS (
  SELECT item_id, CAST(e AS BIGINT) AS epoch, x % a AS l, x // a AS r, 0 AS i, n, a, b FROM rows, m, unnest(range({EPOCHS})) AS t(e)
  UNION ALL
  SELECT item_id, epoch, CASE WHEN i % 2 = 0 THEN (l + v) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + v) % b ELSE r END, i + 1, n, a, b FROM (
    SELECT *, ((t * t + k) % {sh.PRIME} * ((t * 39373 + k) % {sh.PRIME}) + t) % {sh.PRIME} AS v FROM (
      SELECT *, (CASE WHEN i % 2 = 0 THEN r ELSE l END + k) % {sh.PRIME} AS t FROM (
        SELECT *, (42 * 48271 + epoch * 16807 + i % {sh.ROUNDS} * 69621) % {sh.PRIME} AS k FROM w
        WHERE i = 0 OR i % {sh.ROUNDS} > 0 OR l + r * a >= n))))
SELECT item_id, epoch, epoch * n + l + r * a AS step FROM w WHERE i > 0 AND i % {sh.ROUNDS} = 0 AND l + r * a < n""")
def shuffled_epochs(spark, d):
    """Each epoch in an order of its own, without sorting by a random key."""
    items = TB.table(spark, d, "benchmark").select("item_id")
    return sh.shuffled_epochs(items, "item_id", EPOCHS, seed=42).select("item_id", "epoch", "step")
