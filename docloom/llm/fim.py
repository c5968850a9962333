"""Fill-in-middle transformation as a ``pyarrow.compute`` pipeline.

Texts are cut into units (lines with their line feed).  For each Arrow batch the
units of all texts are split into list arrays, flattened with the index of the
text that each comes from, and numbered inside it; two cuts give every unit a
role (prefix, middle or suffix); the units of a role are filtered, rebuilt into
one list a text and joined.  No Python code runs for a single row.

The draws of a text come from its id alone: the first four groups of eight hex
digits of ``sha256("<seed>:<id>")``.  The prefix ends after the smaller, the
middle after the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units.  A text
stays plain if ``h3 % 100 >= rate``, and is written suffix first (spm) if
``h4 % 100 < spm``, else prefix first (psm).  So a retried task, another
partitioning or another run gives the same output.

Defined results: a null text is read as empty; empty texts and texts that hold
one of the marks stay plain, with null sizes; a null id is hashed as no digits;
repeated rows are transformed alike, each on its own; very long texts are
transformed whole, a batch holds one of them at least and some 16 MB of others;
an empty table gives an empty result; only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batches

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
#: Bytes of a batch of several texts.
BATCH = 16 << 20

PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"
_NONE = pa.scalar("", pa.large_string())


def _rebuilt(pieces: pa.Array, parents: np.ndarray, mine: np.ndarray, rows: int) -> pa.Array:
    """The pieces for which ``mine`` holds, one list for each of the rows, joined."""
    counts = np.bincount(parents[mine], minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pieces.filter(pa.array(mine))), _NONE)


def parts_of(texts: pa.Array, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(number of units, prefix, middle, suffix) of each text; ``low`` and
    ``high`` are reduced modulo the number of units and one, and sorted."""
    rows = len(texts)
    if not rows:
        none = pa.array([], pa.large_string())
        return np.zeros(0, np.int64), none, none, none
    lines = pc.split_pattern(texts, "\n")
    flat, parents = lines.flatten(), pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    held = pc.list_value_length(lines).to_numpy().astype(np.int64)
    starts = np.cumsum(held) - held
    ordinal = np.arange(len(flat)) - starts[parents]
    last = ordinal == held[parents] - 1
    # what follows the last line feed is a unit only if it isn't empty
    kept = ~(last & (pc.binary_length(flat).to_numpy() == 0))
    flat = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n").cast(pa.large_string()), _NONE)
    n = np.bincount(parents[kept], minlength=rows)
    a, b = low % (n + 1), high % (n + 1)
    first, second = np.minimum(a, b)[parents], np.maximum(a, b)[parents]
    role = (ordinal >= first).astype(np.int8) + (ordinal >= second)
    return n, *[_rebuilt(flat, parents, kept & (role == r), rows) for r in range(3)]


def _written(form: pa.Array, texts: pa.Array, prefix: pa.Array, middle: pa.Array, suffix: pa.Array, marks: tuple[str, str, str]) -> pa.Array:
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, _NONE)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, _NONE)
    return pc.if_else(pc.equal(form, PLAIN), texts, pc.if_else(pc.equal(form, PSM), psm, spm))


def transform_batch(texts: pa.Array, draws: list[np.ndarray], rate: int, spm: int, marks: tuple[str, str, str]) -> list[pa.Array]:
    """n, form, prefix, middle, suffix (null if plain) and output of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, prefix, middle, suffix = parts_of(texts, draws[0], draws[1])
    plain = pc.or_(pc.equal(texts, ""), pa.array(draws[2] % 100 >= rate))
    for mark in marks:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    form = pc.if_else(plain, PLAIN, pc.if_else(pa.array(draws[3] % 100 < spm), SPM_FORM, PSM))
    output = _written(form, texts, prefix, middle, suffix, marks)
    null = pa.scalar(None, pa.large_string())
    return [pa.array(n, pa.int64()), form, *[pc.if_else(plain, null, x) for x in (prefix, middle, suffix)], output]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """id_col, n (units), form, prefix, middle, suffix (null if plain) and
    output of each row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), digest.alias("digest"))
            .select("id", "text", *drawn))
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, BATCH):
            draws = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
            made = [x.cast(pa.string()) if pa.types.is_large_string(x.type) else x
                    for x in transform_batch(b.column(1), draws, rate, spm, marks)]
            yield pa.record_batch([b.column(0), *made], ["id", "n", "form", "prefix", "middle", "suffix", "output"])

    return (rows.mapInArrow(run, f"id {kind}, n long, form string, prefix string, middle string, suffix string, output string")
            .withColumnRenamed("id", id_col))


def _split(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the (only) mark."""
    both = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def restore_batch(output: pa.Array, form: pa.Array, marks: tuple[str, str, str]) -> pa.Array:
    """The texts, rebuilt from what was written.  (Such a text holds no mark,
    and none can arise where a text and a mark meet.)"""
    p, s, m = marks
    output = output.cast(pa.large_string())
    whole, places = [], []
    for name in (PLAIN, PSM, SPM_FORM):
        at = np.flatnonzero(pc.equal(form, name).to_numpy(zero_copy_only=False))
        out = output.take(pa.array(at))
        if name != PLAIN and len(at):
            first, second = (p, s) if name == PSM else (s, p)
            head, middle = _split(out, m)
            one, two = _split(pc.replace_substring(head, first, "", max_replacements=1), second)
            prefix, suffix = (one, two) if name == PSM else (two, one)
            out = pc.binary_join_element_wise(prefix, middle, suffix, _NONE)
        whole.append(out)
        places.append(at)
    back = np.argsort(np.concatenate(places))
    return pa.concat_arrays(whole).take(pa.array(back))


def restore(written: DataFrame, output: str = "output", form: str = "form", name: str = "restored",
            marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``written`` with the exact text (``name``) rebuilt from output and form."""
    rows = written.select(F.struct(*[written[c] for c in written.columns]).alias("row"), written[output].alias("output"), written[form].alias("form"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, BATCH):
            yield pa.record_batch([b.column(0), restore_batch(b.column(1), b.column(2), marks).cast(pa.string())], ["row", "text"])

    return (rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
            .select("row.*", F.col("text").alias(name)))
