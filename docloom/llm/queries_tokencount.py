"""op8: token counts of the whole ``documents`` table, before and after edits
that Spark derives from the table itself: in each document the ``n_chars / 100 + 1``
characters from a third of it on go, and its source and language come there;
then its first ten characters move to its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register
from .tables import table
from .tokencount import apply_edits, build_trees


def edits_of(docs: DataFrame) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    def one(*values: Column) -> Column:
        return F.struct(*[v.alias(c) for v, c in zip(values, ("seq", "pos", "removed", "inserted"), strict=True)])

    return docs.select("doc_id", F.inline(F.array(
        one(F.lit(1), F.floor(n / 3).cast("int"), (F.floor(n / 100) + 1).cast("int"), F.concat_ws(" ", F.lit(""), "source", "lang")),
        one(F.lit(2), F.lit(0), F.lit(10), F.lit("")),
        one(F.lit(3), F.lit(2**31 - 1), F.lit(0), F.substring("text", 1, 10)))))


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    after = apply_edits(build_trees(docs), edits_of(docs))
    return after.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_encoded",
                        F.size("tree.tokens").cast("long").alias("n_leaves"))
