"""One large JSON document read by many tasks.

Spark can't split a document that isn't one record a line.  Here the file is
read as text with a closing bracket as the line separator, which Spark splits
by byte ranges, and in two passes over the ranges:

1. Each range is reduced to its effect on the scanner's state: how many quotes
   it has (outside escapes) and how it changes the depth, if it starts outside
   or inside a string.  No range starts inside an escape: it starts after a
   bracket.  The effects are composed by two running sums in the order of the
   ranges, which gives every range the state it starts in.
2. Each range cuts its text after the brackets that close a unit.  The piece
   before a range's first cut and the piece after its last are put together
   with their neighbours'; all other units never leave their task.

A unit is a member of the array of ``{"root": [...]}`` or an entry of
``{"id": [...], ...}``.  Spark's own JSON functions parse the units.

What is held in one place: a range's effect on its way to the running sums (a
few numbers for each range; Spark's driver holds as much for each itself), and
one unit.  A document that ends inside a string or a bracket raises.  Bytes are
read as UTF-8.  Null members of an array are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import materialized

# the functions below run in Python workers; see hooks.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE, BACKSLASH = 34, 92


def _fragments(spark: SparkSession, path: str, close: str) -> DataFrame:
    """value (text between closing brackets, in order inside each range), file,
    size (of the file) and start (of the range)."""
    return spark.read.option("lineSep", close).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"))


def _structure(values: pa.Array, close: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, end of each fragment, quotes, change of depth outside strings) of
    fragments, each with its closing bracket."""
    whole = pc.binary_join_element_wise(values.cast(pa.large_string()), pa.scalar(close, pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    text = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    quotes = text == QUOTE
    slashes = text == BACKSLASH
    if slashes.any():
        # a quote after an odd number of backslashes is escaped
        plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(text))))
        at = np.flatnonzero(quotes[1:] & slashes[:-1]) + 1
        quotes[at[(at - 1 - plain[at - 1]) % 2 == 1]] = False
    # fixed values: the brackets { [ and ] }
    change = ((text == 123) | (text == 91)).astype(np.int64) - ((text == 125) | (text == 93))
    return text, offsets[1:] - offsets[0], quotes, change


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a batch that belong to one range each."""
    start = b.column(b.schema.get_field_index("start")).to_numpy()
    code = b.column(b.schema.get_field_index("file")).dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(start)], strict=True):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def range_effects(fragments: DataFrame, close: str) -> DataFrame:
    """file, size, start, quotes, outside, inside (change of depth of a range
    that starts outside or inside a string) and chars (its bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _runs(b):
                text, _, quotes, change = _structure(part.column(0), close)
                inside = (np.cumsum(quotes) - quotes) & 1
                yield pa.record_batch([part.column(1).slice(0, 1), part.column(2).slice(0, 1), part.column(3).slice(0, 1), b.column(4).slice(0, 1),
                                       *[pa.array([int(x)]) for x in (quotes.sum(), change[inside == 0].sum(), change[inside == 1].sum(), len(text))]],
                                      ["file", "size", "start", "n", "quotes", "outside", "inside", "chars"])

    # a batch is a range's part: they are composed like ranges, in the order of n
    return (fragments.withColumn("n", F.monotonically_increasing_id())
            .mapInArrow(run, "file string, size long, start long, n long, quotes long, outside long, inside long, chars long"))


def start_states(fragments: DataFrame, close: str) -> DataFrame:
    """file, start, in_string (0 or 1) and depth of each range."""
    order = Window.partitionBy("file").orderBy("start", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    at = range_effects(fragments, close).withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    step = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    at = at.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    # the last fragment's bracket isn't there if the ranges have a byte more than the file
    end = F.sum("step").over(whole) + F.sum("chars").over(whole) - F.col("size")
    fault = (end != 0) | (F.sum("quotes").over(whole) % 2 != 0)
    checked = F.when(fault, F.raise_error(F.concat(F.lit("JSON document ends inside a string or a bracket: "), F.col("file")))).otherwise(F.col("in_string"))
    return (at.withColumn("in_string", checked).groupBy("file", "start")
            .agg(F.min_by("in_string", "n").alias("in_string"), F.min_by("depth", "n").alias("depth")))


def _cut(fragments: DataFrame, close: str, level: int) -> DataFrame:
    """file, start, seq, ended, dips, text: each range's text, cut after the
    brackets that close down to ``level``.  ``dips``: the piece goes below the
    level, so it isn't a unit only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, low, seq, inside, depth = None, [], level, 0, 0, 0

        def row(ended: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array([own[0]], pa.string()), pa.array([own[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([ended]),
                                    pa.array([low < level]), pa.array([b"".join(held)]).cast(pa.string())],
                                   ["file", "start", "seq", "ended", "dips", "text"])

        for b in batches:
            for part in _runs(b):
                name = (part.column(1)[0].as_py(), part.column(3)[0].as_py())
                if name != own:
                    if own and held:
                        yield row(False)
                    own, held, low, seq = name, [], level, 0
                    inside, depth = part.column(4)[0].as_py(), part.column(5)[0].as_py()
                text, ends, quotes, change = _structure(part.column(0), close)
                total = np.cumsum(quotes) + inside
                at = depth + np.cumsum(np.where((total - quotes) & 1, 0, change))
                inside, depth = int(total[-1] & 1), int(at[-1])
                last = ends - 1
                stops = ends[(at[last] == level) & (total[last] & 1 == 0)]
                if not len(stops):
                    held.append(text.tobytes())
                    low = min(low, int(at.min()))
                    continue
                begins = np.concatenate([[0], stops[:-1]])
                least = np.minimum.reduceat(at[:stops[-1]], begins)
                held.append(text[:stops[0]].tobytes())
                low = min(low, int(least[0]))
                yield row(True)
                seq += 1
                if len(stops) > 1:
                    n = len(stops) - 1
                    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(text))
                    yield pa.record_batch([pa.array([own[0]] * n, pa.string()), pa.array(np.full(n, own[1]), pa.int64()), pa.array(seq + np.arange(n), pa.int64()),
                                           pa.array(np.ones(n, bool)), pa.array(least[1:] < level), texts.cast(pa.string())],
                                          ["file", "start", "seq", "ended", "dips", "text"])
                    seq += n
                rest = text[stops[-1]:]
                held, low = ([rest.tobytes()], int(at[stops[-1]:].min())) if len(rest) else ([], level)
        if own and held:
            yield row(False)

    return fragments.mapInArrow(run, "file string, start long, seq long, ended boolean, dips boolean, text string")


def json_units(spark: SparkSession, path: str, close: str, level: int) -> DataFrame:
    """file, start, seq (the order inside the file), dips and text of each unit:
    what stands between two brackets ``close`` that close down to ``level``."""
    fragments = _fragments(spark, path, close)
    # one row a range, found once
    states = F.broadcast(materialized(start_states(fragments, close), "json-ranges"))
    known = fragments.join(states, ["file", "start"], "left").select(
        "value", "file", "size", "start", F.coalesce("in_string", F.raise_error(F.lit("the ranges of a file have changed between two passes")).cast("long")).alias("in_string"), "depth")
    pieces = _cut(known, close, level)
    # a range's first piece goes on from the range before, its last one goes on in the next
    alone = F.col("ended") & ((F.col("seq") > 0) | (F.col("start") == 0))
    # the number of units that end before: over two rows a range at most
    before = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    parted = pieces.where(~alone).withColumn("unit", F.coalesce(F.sum(F.col("ended").cast("long")).over(before), F.lit(0)))
    part = F.struct("start", "seq", "text")
    stitched = (parted.groupBy("file", "unit").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("dips").alias("dips"), F.max("ended").alias("ended"))
                .where("ended").select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["seq"].alias("seq"), "dips",
                                       F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
    return pieces.where(alone).select("file", "start", "seq", "dips", "text").unionByName(stitched)


def _opening(text: str, level: int) -> tuple[str | None, str]:
    """(key, rest) of a unit that goes below ``level``: the key at depth one
    whose array it opens, and what follows the bracket."""
    depth, key, last, i, begin = level, None, None, 0, 0
    # the depth that it starts at follows from its end, which is ``level``
    walk, j = 0, 0
    while j < len(text):
        c = text[j]
        if c == '"':
            j += 1
            while text[j] != '"':
                j += 2 if text[j] == "\\" else 1
        walk += (c in "{[") - (c in "}]")
        j += 1
    depth = level - walk
    while i < len(text):
        c = text[i]
        if c == '"':
            j = i + 1
            while text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            last, i = text[i:j + 1], j + 1
            continue
        if c in "{[":
            depth += 1
            if c == "[" and depth == level:
                key, begin = last, i + 1
            elif depth == level:
                key = None
        elif c in "}]":
            depth -= 1
        i += 1
    return key, text[begin:]


def read_json_document(spark: SparkSession, path: str, root: str, elem: T.StructType) -> DataFrame:
    """``{"<root>": [ {...}, ... ]}`` files of any size, each read by as
    many tasks as it has byte ranges.  Other keys at depth one are skipped."""
    import json
    units = json_units(spark, path, "}", 2)

    @F.udf("struct<key:string,text:string>")
    def opened(text):  # once for each key of a document
        key, rest = _opening(text, 2)
        return (None if key is None else json.loads(key)), rest

    marked = materialized(units.where("dips").select("file", "start", "seq", F.inline(F.array(opened("text"))))
                          .select("file", "start", "seq", "key", "text"), "json-keys")
    place = F.struct("start", "seq")
    spans = (marked.select("file", place.alias("first"), "key", F.lead(place).over(Window.partitionBy("file").orderBy("start", "seq")).alias("next"))
             .where(F.col("key") == root).select("file", "first", "next"))
    inner = (units.where("NOT dips").select("file", place.alias("place"), "text").join(spans, "file")
             .where((F.col("place") > F.col("first")) & (F.col("next").isNull() | (F.col("place") < F.col("next")))).select("text"))
    members = F.concat(F.lit("["), F.regexp_replace("text", r"^[\s,]*", ""), F.lit("]"))
    return (inner.unionByName(marked.where(F.col("key") == root).select("text"))
            .select(F.explode(F.from_json(members, T.ArrayType(elem))).alias("r")).where("r IS NOT NULL").select("r.*"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``{"<id>": [ {question, answers}, ... ], ...}`` files of any size,
    each read by as many tasks as it has byte ranges; a unit is an id's list."""
    units = json_units(spark, path, "]", 1)
    entry = F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s,{]*", ""), F.lit("}"))
    return (units.select(F.explode(F.from_json(entry, S.FAQ_MAP)).alias("k", "recs"))
            .select(F.col("k").cast("long").alias("faqid"), F.posexplode("recs").alias("rec", "r"))
            .select("faqid", "rec", F.col("r.question").alias("question"), F.col("r.answers").alias("answers")))
