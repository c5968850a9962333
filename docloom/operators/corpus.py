"""Corpus building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .groups import ordered_segments
from .joins import restrict_to_keys
from .ranks import rank_within, running_max_within

# Prefixes of the FAQ content (questions, then answers).
FAQ_QUESTION_PREFIX = "問題："
FAQ_ANSWER_PREFIX = "答案："
FAQ_CATEGORY = "faq"


def parse_filename(df: DataFrame, filename: str = "filename", number_token: str = "last") -> DataFrame:
    """``category`` = first ``_`` token, ``doc_num`` = last (or second)
    ``_`` token of the name without ``.pdf``, cast strictly to bigint."""
    stem = F.replace(F.col(filename), F.lit(".pdf"), F.lit(""))
    parts = F.split(stem, "_")
    num = F.element_at(parts, -1) if number_token == "last" else F.get(parts, 1)
    return (df.withColumn("category", F.get(F.split(F.col(filename), "_"), 0))
            .withColumn("doc_num", num.cast("long")))


def with_content_len(df: DataFrame, content: str = "content", name: str = "content_len") -> DataFrame:
    """P5: code-point length, null → 0."""
    return df.withColumn(name, F.coalesce(F.length(content), F.lit(0)))


def file_stem(filename: str = "filename") -> Column:
    return F.regexp_replace(F.col(filename), r"\.[^.]*$", "")


def apply_fallback(corpus: DataFrame, fallback: DataFrame, min_len: int = 50,
                   blocklist: Sequence[str] = (), missing: str = "fail",
                   stem_col: str = "stem", text_col: str = "text") -> DataFrame:
    """Rows that are too short (``content_len < min_len``) or
    blocklisted take their text from ``fallback`` (keyed by file stem),
    junk-cleaned and wrapped in a page-0 tag (clean first, wrap after: Q23);
    then ``content_len`` is recomputed.

    Only the flagged rows are joined: the corpus is split into flagged and
    unflagged branches, so the bulk of it is never shuffled.  ``missing``:
    ``fail`` raises at run time when a flagged row has no fallback, ``keep``
    leaves its content as it was."""
    if missing not in ("fail", "keep"):
        raise ValueError("missing must be 'fail' or 'keep'")
    cols = corpus.columns
    low = (F.col("content_len") < min_len) | F.col("filename").isin(list(blocklist))
    low = F.coalesce(low, F.lit(True))
    keep = corpus.where(~low)
    flagged = corpus.where(low).withColumn("_fb_stem", file_stem("filename"))
    fb = fallback.select(F.col(stem_col).alias("_fb_stem"), F.col(text_col).alias("_fb_text"))
    # only the fallback texts of flagged rows are needed: filter the fallback
    # side by the (size-checked, broadcast) flagged stems before joining
    fb = restrict_to_keys(fb, flagged, ["_fb_stem"])
    joined = flagged.join(fb, ["_fb_stem"], "left")
    new = tx.page_tag(F.lit(0), tx.remove_junk("_fb_text"))
    if missing == "fail":
        new = F.when(F.col("_fb_text").isNull(),
                     F.raise_error(F.concat(F.lit("no fallback text for "), F.col("filename")))).otherwise(new)
    else:
        new = F.when(F.col("_fb_text").isNull(), F.col("content")).otherwise(new)
    fixed = with_content_len(joined.withColumn("content", new)).select(*cols)
    return keep.unionByName(fixed)


def faq_records(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", question_role: str = "user", answer_role: str = "assistant") -> DataFrame:
    """Chat turns → FAQ records ``(faqid, rec, question, answers[])``: each
    question turn opens a record; the answer turns after it (before the next
    question) are its answers, in turn order.  The record id is the running
    max of question-turn numbers inside the conversation, computed with
    range buckets of ``turn`` so a very long conversation is not one task."""
    t = turns.withColumn("_q_turn", F.when(F.col(role) == question_role, F.col(turn)))
    t = running_max_within(t, "_q_turn", turn, [conv], name="_rec").drop("_q_turn")
    t = t.where(F.col("_rec").isNotNull())
    return (t.groupBy(conv, "_rec")
            .agg(F.max(F.when(F.col(role) == question_role, F.col(text))).alias("question"),
                 F.sort_array(F.collect_list(F.when(F.col(role) == answer_role,
                                                    F.struct(F.col(turn), F.col(text))))).alias("_ans"))
            .select(F.col(conv).alias("faqid"), F.col("_rec").alias("rec"), "question",
                    F.transform("_ans", lambda a: a[text]).alias("answers")))


def faq_to_corpus(records: DataFrame, key: str = "faqid", order: str = "rec",
                  question: str = "question", answers: str = "answers",
                  category: str = FAQ_CATEGORY) -> DataFrame:
    """One corpus row per FAQ id:
    ``'問題：' + '\\n'.join(questions) + '答案：' + '\\n'.join(a、b及c per record)``,
    joined in record order.  Null pieces are skipped; a group with no
    answer still gets its prefix (Spark's ``concat`` is null-propagating, so
    every part is coalesced)."""
    r = records.withColumn("_a", tx.join_cjk_list(answers))
    g = (r.groupBy(key)
         .agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(question).alias("q"),
                                                   F.col("_a").alias("a")))).alias("_recs")))
    qs = F.array_join(F.transform("_recs", lambda x: x["q"]), "\n")
    ans = F.array_join(F.transform("_recs", lambda x: x["a"]), "\n")
    content = F.concat(F.lit(FAQ_QUESTION_PREFIX), F.coalesce(qs, F.lit("")),
                       F.lit(FAQ_ANSWER_PREFIX), F.coalesce(ans, F.lit("")))
    out = g.select(F.lit(category).alias("category"), content.alias("content"),
                   F.col(key).cast("long").alias("doc_num"))
    return with_content_len(out).select("category", "content", "content_len", "doc_num")


def faq_segments(records: DataFrame, max_chars: int, key: str = "faqid", order: str = "rec",
                 question: str = "question", answers: str = "answers", category: str = FAQ_CATEGORY) -> DataFrame:
    """A1 for FAQ ids of any size: the text of ``faq_to_corpus`` in numbered
    segments of about ``max_chars`` (``groups.ordered_segments``); an id whose
    text fits is one row with the text ``faq_to_corpus`` gives."""
    pieces = records.select(F.col(key).alias("_id"), F.col(order).alias("_rec"), F.posexplode(
        F.array(F.col(question), tx.join_cjk_list(answers))).alias("_part", "_piece")).where(F.col("_piece").isNotNull())
    pieces = rank_within(pieces, "_rec", ["_id", "_part"], name="_n")
    pieces = pieces.withColumn("_piece", F.concat(F.when(F.col("_n") > 0, "\n").otherwise(""), F.col("_piece")))
    prefixes = records.select(F.col(key).alias("_id")).distinct().select("_id", F.posexplode(
        F.array(F.lit(FAQ_QUESTION_PREFIX), F.lit(FAQ_ANSWER_PREFIX))).alias("_part", "_piece"))
    parts = (pieces.select("_id", "_part", "_piece", "_n").unionByName(prefixes.withColumn("_n", F.lit(-1).cast("long")))
             .withColumn("_order", F.struct("_part", "_n")))
    out = ordered_segments(parts, ["_id"], "_order", F.col("_piece"), max_chars)
    return (with_content_len(out.withColumn("category", F.lit(category)))
            .select("category", "segment_no", "content", "content_len", F.col("_id").cast("long").alias("doc_num")))


def union_corpora(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing in one input becomes null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _tagged_page(page_no: str, text: str) -> Column:
    stripped = tx.strip_space(text)
    return F.when(stripped != "", tx.page_tag(F.col(page_no), stripped))


def pages_to_segments(pages: DataFrame, max_chars: int, doc: str = "doc_id", page_no: str = "page_no",
                      text: str = "text", name: str = "content") -> DataFrame:
    """A9 for documents of any size: the text of ``pages_to_document`` in
    numbered segments of whole pages, each of about ``max_chars``; a document
    that fits is segment 0."""
    return ordered_segments(pages, [doc], page_no, _tagged_page(page_no, text), max_chars, name)


def pages_to_document(pages: DataFrame, doc: str = "doc_id", page_no: str = "page_no",
                      text: str = "text", name: str = "content") -> DataFrame:
    """One document per ``doc``: page texts stripped, blank pages
    skipped (their numbers kept), each wrapped as ``<page number="i">``,
    joined in page order; a document with no text at all → null."""
    tagged = _tagged_page(page_no, text)
    g = pages.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.when(tagged.isNotNull(), F.struct(F.col(page_no), tagged.alias("t")))))
        .alias("_pages"))
    return g.select(doc, F.when(F.size("_pages") > 0,
                                F.array_join(F.transform("_pages", lambda p: p["t"]), "")).alias(name))
