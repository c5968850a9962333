"""QA dataset assembly: questions ⋈ truths, ordered multi-lookup context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .joins import restrict_to_keys
from .ranks import join_null_safe


def prepare_questions(questions: DataFrame, query: str = "query") -> DataFrame:
    """Quote normalisation on the question text."""
    return questions.withColumn(query, tx.normalize_quotes(query))


def join_truths(questions: DataFrame, truths: DataFrame,
                on: Sequence[str] = ("qid", "category")) -> DataFrame:
    """Inner equi-join; many-to-many when keys repeat (as pandas ``merge``)."""
    return questions.join(truths, list(on), "inner")


def first_per_key(corpus: DataFrame, order_col: str, keys: Sequence[str] = ("category", "doc_num"),
                  value: str = "content") -> DataFrame:
    """One corpus row per key, the first by ``order_col`` (a NULL order
    counts as last).

    ``min_by`` is partially aggregated map-side, so a key with many copies
    collapses to one row per map task before the shuffle."""
    return corpus.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(F.col(order_col).isNull(), F.col(order_col))).alias(value))


def _references(questions: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    return questions.select(*key, F.posexplode(source).alias("pos", "doc_num"))


def missing_references(questions: DataFrame, corpus: DataFrame, source: str = "source",
                       key: Sequence[str] = ("qid", "category")) -> DataFrame:
    """Candidate ids with no corpus row of the same category
    (``qid, category, pos, doc_num``)."""
    refs = _references(questions, key, source)
    on = ["category", "doc_num"]
    # find which referenced keys exist with a (size-checked) broadcast
    # semi-join on the corpus side, then anti-join the small results
    found = restrict_to_keys(corpus.select(*on), refs, on).distinct()
    return refs.join(found, on, "left_anti")


def assemble_context(questions: DataFrame, corpus: DataFrame, order_col: str, source: str = "source",
                     on_missing: str = "fail", key: Sequence[str] = ("qid", "category")) -> DataFrame:
    """Resolve each question's ordered candidate ids to corpus text and
    concatenate them as ``<article id=…>`` tags, in candidate order.  Of
    corpus rows with the same key the first by ``order_col`` counts (J3).

    Plan: the distinct (key, candidate list) are exploded, one row per
    position; the corpus is restricted to the referenced (category, doc_num)
    keys by a semi-join, reduced to its first rows, and joined; parts are
    regrouped by the list they came from, in order, and joined back to the
    rows.  So a question that stands in several rows is assembled once, and
    each of its rows gets that context.  Questions with no candidates get
    ``''``.  ``on_missing``: ``fail`` raises at run time on an unresolved id
    (lazy, inside the plan), ``skip`` drops it.
    """
    if on_missing not in ("fail", "skip"):
        raise ValueError("on_missing must be 'fail' or 'skip'")
    of = [*key, source]
    distinct = questions.select(*of).where(F.size(source) > 0).distinct()
    refs = distinct.select(*of, F.posexplode(source).alias("pos", "doc_num"))
    lookup = restrict_to_keys(corpus.select("category", "doc_num", "content", order_col), refs, ["category", "doc_num"])
    lookup = first_per_key(lookup, order_col)
    how = "left" if on_missing == "fail" else "inner"
    joined = refs.join(lookup, ["category", "doc_num"], how)
    piece = tx.article_tag("category", "doc_num", "content")
    if on_missing == "fail":
        piece = F.when(F.col("content").isNull(), F.raise_error(F.concat(
            F.lit("unresolved reference "), F.col("category"), F.lit("_"),
            F.col("doc_num").cast("string")))).otherwise(piece)
    ctx = (joined.groupBy(*of)
           .agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("parts"))
           .select(*of, F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("context")))
    return (join_null_safe(questions.drop("context"), ctx, of, "left")
            .withColumn("context", F.coalesce("context", F.lit(""))))


def answer_article_id(category: str = "category", retrieve: str = "retrieve"):
    """``category_retrieve`` composite id (null when either is null)."""
    return F.when(F.col(retrieve).isNotNull() & F.col(category).isNotNull(),
                  F.concat_ws("_", F.col(category), F.col(retrieve).cast("string")))


def competition_dataset(questions: DataFrame, truths: DataFrame | None = None,
                        corpus: DataFrame | None = None, order_col: str | None = None,
                        on_missing: str = "fail") -> DataFrame:
    """Questions only / + truths / + corpus, composed from the steps above
    (a corpus needs ``order_col``, by which its first rows count).  Contexts
    are assembled before the truths multiply the rows.

    Output columns follow the reference: ``qid, question, category, context,
    answer_in_articleid`` (the last two only when corpus / truths are given)."""
    df = prepare_questions(questions)
    if corpus is not None:
        if order_col is None:
            raise ValueError("order_col is needed: the first corpus row of a key counts")
        if truths is not None:  # only questions with a truth
            df = df.join(truths.select("qid", "category").distinct(), ["qid", "category"], "left_semi")
        df = assemble_context(df, corpus, order_col, on_missing=on_missing)
    if truths is not None:
        df = join_truths(df, truths.drop("generate"))
    if corpus is None:
        return df
    if truths is not None:
        df = df.withColumn("answer_in_articleid", answer_article_id())
    return df.drop("source", "retrieve").withColumnRenamed("query", "question")
