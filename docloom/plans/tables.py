"""How the driver's parquet tables play the reference's entities.

Each function derives one reference entity from the given tables with Spark
expressions only, so the work grows with the tables.  The DuckDB oracle in
``plans/oracle.py`` spells the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import range_partitions

# Fixed values of the fixture mapping (shared with the oracle SQL).
LANG_BY_MOD = ["en", "fr", "de", "es"]
CHECKPOINTS = [120, 480, 600]
LATIN = "abcdefghijklmnopqrstuvwxyz"
CJK_26 = "一中文字人大小山水火木金土日月天地上下本票融資料問海"


def table(spark: SparkSession, sf_dir: str, name: str, balanced: bool = False) -> DataFrame:
    """One driver table.  The given files are one row group each, so one split;
    ``balanced`` deals their rows round-robin over the session's shuffle
    partitions, before CPU-heavy per-row work."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(range_partitions(df)) if balanced else df


def category_of(item_id) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in LANG_BY_MOD]),
                        (F.col(item_id) % len(LANG_BY_MOD) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → (filename, category, content, content_len, doc_num)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("lang").alias("category"),
        F.col("text").alias("content"),
        F.coalesce(F.length("text"), F.lit(0)).alias("content_len"),
        F.col("doc_id").alias("doc_num"),
    )


#: Neighbouring document ids that a question's candidates are taken from.
IDS_PER_QUESTION = 32


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and benchmark → (qid, query, category, source).

    Question ``qid`` stands for the documents with ``doc_id div 32 = qid``;
    its category goes by ``qid % 4``, ``source`` lists the ids of that
    category among them (all of them, ascending; null when there is none), and
    its text is the benchmark item ``qid % n_items``.  So there are as many
    questions as documents / 32, and a list has 32 ids at most, 8 on average,
    at every scale factor."""
    b = table(spark, sf_dir, "benchmark")
    n_items = b.select(F.count(F.lit(1))).scalar()  # lazy scalar subquery, no driver round trip
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / IDS_PER_QUESTION).alias("qid"), "doc_id", "lang")
    own = F.col("lang") == category_of("qid")
    listed = (d.groupBy("qid").agg(F.sort_array(F.collect_list(F.when(own, F.col("doc_id")))).alias("source"))
              .select("qid", category_of("qid").alias("category"),
                      F.when(F.size("source") > 0, F.col("source")).alias("source"), (F.col("qid") % n_items).alias("item_id")))
    return (listed.join(b.select("item_id", F.col("text").alias("query")), "item_id")
            .select("qid", "query", "category", "source"))


def truths(qs: DataFrame) -> DataFrame:
    """Ground truths: ``retrieve = source[qid % size(source)]`` where size > 0."""
    return (qs.where(F.size("source") > 0)
            .select("qid", "category",
                    F.element_at("source", (F.col("qid") % F.size("source") + 1).cast("int")).alias("retrieve"),
                    F.lit(None).cast("string").alias("generate")))


def cjk_text(col: str = "text") -> F.Column:
    """Latin letters → 26 CJK chars, so the CJK cleaners have work to do."""
    return F.translate(F.col(col), LATIN, CJK_26)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings → (vec_id, start_logits, end_logits, true_start, true_end)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("start_logits"),
                    F.reverse("embedding").alias("end_logits"),
                    F.col("label").cast("long").alias("true_start"),
                    (F.col("label") + F.col("vec_id") % 5).cast("long").alias("true_end"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → prediction rows (qid, category, retrieve, incre_num_by, checkpoint)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("qid"),
        F.col("event_type").alias("category"),
        F.get_json_object("props", "$.k").alias("retrieve"),
        ((F.col("event_id") % 6) * 5).cast("int").alias("incre_num_by"),
        F.element_at(F.array(*[F.lit(c) for c in CHECKPOINTS]),
                     (F.col("event_id") % 3 + 1).cast("int")).alias("checkpoint"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → trials (trial_id, a, b, state)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("trial_id"),
                    F.col("p_retailprice").alias("a"),
                    F.col("p_size").cast("double").alias("b"),
                    F.when(F.col("p_partkey") % 7 == 0, F.lit("pruned"))
                    .otherwise(F.lit("complete")).alias("state"),
                    "p_name", "p_brand", "p_type")
