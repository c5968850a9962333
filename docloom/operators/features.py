"""Prompt rendering, token windows and labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import text as tx

# The reference's question templates (find-id task and free
# answer task) and its system message.  The few-shot example message is an
# argument (it embeds a tokenizer-specific separator token).
QUESTION_TEMPLATE_FIND_ID = "問題：「{question}」這個問題可以在什麼編號的參考資料中找到答案？\n參考資料：<context>"
QUESTION_TEMPLATE_ANSWER = "問題：{question}\n參考資料："
SYSTEM_MESSAGE = "你是一個擅長回答利用自己知識以及參考資料回答金融問題的專家助手。"
ASSISTANT_ACK = "了解，請提供給我問題和參考資料。"

# A ChatML-style role layout used as the default chat format (the reference
# delegates this to the model's own template).
CHAT_TURN = "<|im_start|>{role}\n{content}<|im_end|>\n"
CHAT_GENERATION_SUFFIX = "<|im_start|>assistant\n"


def render_question(df: DataFrame, question: str = "question", task: str = "find_id",
                    name: str = "prompt", compat_double_wrap: bool = False) -> DataFrame:
    """the per-question user message (stripped, as the reference does).

    The find-id template ends in ``<context>`` and the reference wraps the
    context in ``<context>…</context>`` again (Q17); by default the message
    stops before the tag so the context is wrapped once (``context_tag``)."""
    tpl = QUESTION_TEMPLATE_FIND_ID if task == "find_id" else QUESTION_TEMPLATE_ANSWER
    if not compat_double_wrap and tpl.endswith("<context>"):
        tpl = tpl[: -len("<context>")]
    return df.withColumn(name, tx.strip_space(tx.render(tpl, question=question)))


def model_input(prompt, context) -> Column:
    """prompt ‖ wrapped context."""
    return F.concat(F.col(prompt), tx.context_tag(context))


def prompt_messages(question: str = "question", context: str = "context", task: str = "find_id",
                    system: str = SYSTEM_MESSAGE, example: str | Column | None = None,
                    acknowledgement: str = ASSISTANT_ACK, answer: str | None = None) -> Column:
    """the whole prompt as ``array<struct<role, content>>``: the system
    message, an example turn with the assistant's acknowledgement (both only
    where ``example`` is not null), the question with its context, and, for
    training, the ``answer`` column as the assistant's turn where not null.

    ``task``: ``find_id`` wraps the context in its tag, once; ``answer`` asks
    for a free answer and has the context as it is.  A null question or
    context counts as empty."""
    if task not in ("find_id", "answer"):
        raise ValueError("task must be 'find_id' or 'answer'")
    tpl = QUESTION_TEMPLATE_FIND_ID.removesuffix("<context>") if task == "find_id" else QUESTION_TEMPLATE_ANSWER
    asked = tx.strip_space(tx.render(tpl, question=F.coalesce(F.col(question), F.lit(""))))
    given = F.coalesce(F.col(context), F.lit(""))
    asked = F.concat(asked, tx.context_tag(given) if task == "find_id" else given)
    shown = F.lit(None).cast("string") if example is None else F.lit(example) if isinstance(example, str) else example
    said = F.lit(None).cast("string") if answer is None else F.col(answer)
    turns = [("system", F.lit(system)), ("user", shown), ("assistant", F.when(shown.isNotNull(), F.lit(acknowledgement))),
             ("user", asked), ("assistant", said)]
    return F.filter(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns]),
                    lambda m: m["content"].isNotNull())


def render_chat(messages: Column, turn: str = CHAT_TURN, add_generation_prompt: bool = False,
                generation_suffix: str = CHAT_GENERATION_SUFFIX) -> Column:
    """fold an ``array<struct<role, content>>`` into one string with a
    per-turn layout; optional generation suffix.  No template engine."""
    body = F.array_join(F.transform(messages, lambda m: tx.render(turn, role=m["role"], content=m["content"])), "")
    return F.concat(body, F.lit(generation_suffix)) if add_generation_prompt else body


def strip_header(text, begin: str, end: str, middle_regex: str) -> Column:
    """remove an auto-inserted header ``begin + <middle_regex> + end``;
    the fixed parts are quoted literally (``\\Q…\\E``)."""
    pat = "\\Q" + begin + "\\E" + middle_regex + "\\Q" + end + "\\E"
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, pat, "")


def conversation_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                          role: str = "role", text: str = "text") -> DataFrame:
    """Turns → one ``array<struct<role, content>>`` per conversation, in turn order."""
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(
        F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return g.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                               m["content"].alias("content"))).alias("messages"))


def whitespace_tokens(text) -> Column:
    """F21 stand-in: whitespace tokens (pure expression)."""
    return F.split(F.col(text) if isinstance(text, str) else text, " ")


def char_tokens(text) -> Column:
    """F21 stand-in: one token per code point (supplementary-plane
    characters stay whole); empty text → no tokens."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def window_starts(n: Column, width: int, overlap: int) -> Column:
    """Start offsets of overlapping windows: ``0, step, 2·step … last``
    with ``step = width − overlap`` and ``last = ceil(max(n−width,0)/step)·step``."""
    step = width - overlap
    if step <= 0 or width <= 0:
        raise ValueError("width must exceed overlap")
    last = F.ceil(F.greatest(n - width, F.lit(0)) / step) * step
    return F.sequence(F.lit(0), last.cast("int"), F.lit(step))


def token_windows(df: DataFrame, tokens: str, width: int, overlap: int = 30,
                  prompt: str | None = None, max_length: int | None = None,
                  keep_tokens: bool = False, along: str | None = None) -> DataFrame:
    """Cut ``tokens`` into overlapping windows (one output row per
    chunk, parent columns ride along — no join back).  With ``prompt`` the
    prompt tokens lead every chunk and ``max_length`` (total) fixes the
    context width as ``max_length − len(prompt)``.  Adds ``chunk_no``,
    ``token_start``, ``chunk`` and ``is_last``.  All windows are kept, also
    for a single example.

    The chunks are sliced inside the generator and the source token array
    is not copied onto the chunk rows (unless ``keep_tokens``): a long
    document's token array would otherwise be repeated on every chunk.  Of
    the list ``along`` each chunk gets the value at its number, not the list."""
    t = F.col(tokens)
    n = F.size(t)
    if prompt is not None and max_length is not None:
        width_c = F.lit(max_length) - F.size(prompt)
        step = width_c - overlap
        last = F.ceil(F.greatest(n - width_c, F.lit(0)) / step) * step
        starts = F.when(step > 0, F.sequence(F.lit(0), last.cast("int"), step.cast("int"))).otherwise(
            F.raise_error(F.concat(F.lit("prompt of "), F.size(prompt).cast("string"),
                                   F.lit(" tokens leaves no room for a window of max_length "),
                                   F.lit(str(max_length)), F.lit(" with overlap "), F.lit(str(overlap)))))
    else:
        width_c = F.lit(width)
        starts = window_starts(n, width, overlap)

    def piece(st, i):
        body = F.slice(t, st + 1, width_c.cast("int"))
        chunk = F.concat(F.col(prompt), body) if prompt is not None else body
        own = [F.get(along, i).alias(along)] if along is not None else []
        return F.struct(st.alias("token_start"), chunk.alias("chunk"), (st + width_c >= n).alias("is_last"), *own)

    keep = [c for c in df.columns if (keep_tokens or c != tokens) and c != along]
    own = [f"_tw.{along}"] if along is not None else []
    return (df.select(*keep, F.posexplode(F.transform(starts, piece)).alias("chunk_no", "_tw"))
            .select(*keep, "chunk_no", "_tw.token_start", "_tw.chunk", "_tw.is_last", *own))


def label_chunks(df: DataFrame, chunk: str = "chunk", target: str = "target") -> DataFrame:
    """F24 per chunk: ``start_positions``/``end_positions`` (end exclusive)
    of the earliest occurrence of the answer tokens, and ``found``."""
    s = sp.answer_span(chunk, target)
    return (df.withColumn("start_positions", s["start"])
            .withColumn("end_positions", s["end"])
            .withColumn("found", s["found"]))


def generative_labels(df: DataFrame, answer_tokens: str, name: str = "labels") -> DataFrame:
    """on the free-answer path every chunk carries the answer's tokens
    as its labels (chunks are exploded from their parent, so this is a
    column pass-through, flattened when the answer is a list of pieces)."""
    t = dict(df.dtypes)[answer_tokens]
    col = F.flatten(answer_tokens) if t.startswith("array<array") else F.col(answer_tokens)
    return df.withColumn(name, col)


def pad_batches(df: DataFrame, tokens: str, batch: str = "batch_no", pad: str | int = 0,
                name: str = "input_ids") -> DataFrame:
    """F32: pad each row to the longest row of its batch and add
    ``attention_mask``.  The window is partitioned by batch, so each task
    sees at most one batch's rows per partition."""
    w = Window.partitionBy(batch)
    m = F.max(F.size(tokens)).over(w)
    return (df.withColumn("padded_len", m.cast("long"))
            .withColumn(name, sp.pad_to(tokens, F.col("padded_len"), pad))
            .withColumn("attention_mask", sp.attention_mask(tokens, F.col("padded_len"))))


def tokenize_with(df: DataFrame, text: str, fn: Callable, name: str = "input_ids",
                  return_type: str = "array<int>") -> DataFrame:
    """F21 hook: a user tokenizer applied in Arrow batches (``pandas_udf``);
    ``fn`` maps a pandas Series of strings to a Series of lists."""
    from pyspark.sql.functions import pandas_udf

    udf = pandas_udf(fn, return_type)
    return df.withColumn(name, udf(F.col(text)))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """P10: add each missing column as a literal, else fill its nulls."""
    for c, v in defaults.items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            df = df.withColumn(c, F.lit(v))
    return df


def build_qa_features(df: DataFrame, question: str = "question", context: str = "context",
                      answer: str | None = "answer_in_articleid", order: str = "qid",
                      tokenize: Callable[[Column], Column] = char_tokens, max_length: int = 512,
                      overlap: int = 30, pad: str | int = "<pad>") -> DataFrame:
    """The find-id feature map, end to end (F12 F10 F15 F21 W2 F24 F32 J5):
    the rendered question is the prompt of every chunk; the wrapped context
    is cut into overlapping windows of ``max_length − len(prompt)``
    tokens; each chunk is labelled with the earliest answer-id span inside it
    (``start_positions``/``end_positions``, end exclusive, plus ``found``);
    chunks are padded to the longest chunk of their example (the full width
    whenever an example has more than one chunk — a closed form, no window);
    ``overflow_to_sample_mapping`` is the example's row position by
    ``order``.  Parent columns ride along on every chunk (no join back).
    Examples are hash-partitioned by ``order`` before the expansion."""
    from .ranks import range_partitions
    from .splits import row_positions

    rows = row_positions(df, order, name="overflow_to_sample_mapping")
    # the expansion below (tokens → many chunks per example) is CPU-heavy;
    # the partition count is explicit, since AQE would coalesce by bytes
    rows = rows.repartition(range_partitions(rows), order)
    rows = render_question(rows, question=question, name="_qf_prompt")
    rows = (rows.withColumn("_qf_ptok", tokenize(F.col("_qf_prompt")))
            .withColumn("_qf_ctok", tokenize(tx.context_tag(context))))
    if answer is not None:
        rows = rows.withColumn("_qf_target", tokenize(F.col(answer)))
    width = F.lit(max_length) - F.size("_qf_ptok")
    rows = (rows.withColumn("padded_len", (F.size("_qf_ptok") + F.least(width, F.size("_qf_ctok"))).cast("long"))
            .drop(question, context, "_qf_prompt"))
    w = token_windows(rows, "_qf_ctok", width=0, overlap=overlap, prompt="_qf_ptok", max_length=max_length)
    if answer is not None:
        w = label_chunks(w, "chunk", "_qf_target")
    return (w
            .withColumn("input_ids", sp.pad_to("chunk", F.col("padded_len"), pad))
            .withColumn("attention_mask", sp.attention_mask("chunk", F.col("padded_len")))
            .drop("_qf_prompt", "_qf_ptok", "_qf_ctok", "_qf_target", "chunk", "token_start", "is_last"))
