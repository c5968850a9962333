"""Work on distinct words, applied to every text.

Documents are packed into blocks of bounded size: each block keeps its distinct
words and, in place of the texts, numbers of words.  Something is then computed
once for each distinct word of the corpus (its count, its score, its pieces),
and comes back to the blocks.  What is shuffled is a block's distinct words,
once, not its tokens; no word is a hot key: it comes once from each block.

* ``pack``: documents to blocks, a table bucketed by block that is never
  shuffled; and, by hash bucket of words, a table of the bucket's distinct words
  in order and of each block's places among them.
* ``numbered``: the distinct words of the corpus; a word's number holds its
  bucket and its place.
* ``returned``: values by word number, back in each block's order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .words import _BASE, LOWER, NON_SPACE, SAME, Slice, _runs, batches, joined, scan

#: Words of a block at most (but for a longer text, which is a block of its own).
BLOCK_WORDS = 1_600_000
#: Rows for each hash bucket of words.
BUCKET_ROWS = 512
#: Buckets of a table (files, for each writer, and tasks) at most; each holds as
#: many hash buckets as there are more of them.
TABLE_BUCKETS = 8192
PLACE_BITS = 40

Splitter = Callable[[pa.Array], Iterator[Slice]]


def plain_words(texts: pa.Array) -> Iterator[Slice]:
    """Runs of other than blanks, A-Z lower-cased."""
    return scan(texts, NON_SPACE, LOWER)


def spaced_words(texts: pa.Array, runs: bool = False) -> Iterator[Slice]:
    """Pre-tokens: a blank is put before each text that isn't empty; a word
    starts at each blank (with ``runs``: at the first blank of a run), each
    line feed, and after a line feed."""
    for row, after, bounds in joined(texts, SAME):
        # rows are followed by a blank: turned into the blank before the next row's text
        text = np.concatenate([[32], after[:-1]]).astype(np.uint8)
        row_at, ends_at = bounds[:-1], bounds[1:]
        blank, feed = text == 32, text == 10
        first = blank | feed
        if runs:
            first[1:] &= ~(blank[1:] & blank[:-1])
        first[1:] |= feed[:-1]
        first[row_at] = ends_at - row_at > 1  # an empty text has no words
        starts = np.flatnonzero(first)
        rows = np.searchsorted(row_at, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(text)), ends_at[rows])
        yield Slice(row, len(row_at), text, starts, ends, np.searchsorted(starts, bounds),
                    _runs(text.astype(np.uint64) + np.uint64(1), starts, ends, _BASE[0]), row_at)


def run_words(texts: pa.Array) -> Iterator[Slice]:
    """``spaced_words`` that start at the first blank of a run, so that pieces
    of several blanks match."""
    return spaced_words(texts, runs=True)


def _letters(parts: list[Slice], of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes): the bytes of words, one after the other; word at[i] of slice of[i]."""
    sizes, begins = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    shift, texts = 0, []
    for p, s in enumerate(parts):
        mine = of == p
        begins[mine] = s.starts[at[mine]] + shift
        sizes[mine] = (s.ends - s.starts)[at[mine]]
        texts.append(s.text)
        shift += len(s.text)
    text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    ends = np.cumsum(sizes)
    return text[np.arange(sizes.sum()) - np.repeat(ends - sizes - begins, sizes)], sizes


def _as_bytes(sizes: np.ndarray) -> np.ndarray:
    """Sizes as bytes: a size of 255 or more has as many bytes 255 before its rest."""
    out = np.full((sizes // 255 + 1).sum(), 255, np.uint8)
    out[np.cumsum(sizes // 255 + 1) - 1] = sizes % 255
    return out


def _from_bytes(data: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(data.astype(np.int64))[data < 255]]))


def _words(letters: pa.Array, widths: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each row, all words) from their letters, one after the other,
    and widths in bytes."""
    sizes = [_from_bytes(np.frombuffer(w, np.uint8)) for w in widths.to_pylist()]
    data = b"".join(letters.cast(pa.binary()).to_pylist())
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return np.array([len(x) for x in sizes]), pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _block(parts: list[Slice], ids: list[pa.Array], learn: list[np.ndarray], name: int, buckets: int) -> pa.RecordBatch:
    hashes = np.concatenate([s.hashes for s in parts])
    found, first, code, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum([len(s.hashes) for s in parts])])
    taught = np.concatenate([x[s.row_of_words()] for x, s in zip(learn, parts, strict=True)])
    learnt = np.bincount(code, taught, len(found)).astype(np.int64)
    bucket = (found >> np.uint64(20)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    by_place, counts, learnt, bucket = first[order], counts[order], learnt[order], bucket[order]
    # tokens are written as the rank of their word by count, its low byte apart: small numbers
    rank = np.empty(len(found), np.int64)
    rank[order[np.argsort(-counts, kind="stable")]] = np.arange(len(found))
    of = np.searchsorted(starts, by_place, "right") - 1
    letters, widths = _letters(parts, of, by_place - starts[of])
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    edges = np.append(cuts, len(bucket))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.astype(np.int32)))
    spelled = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.concatenate([[0], np.cumsum(widths)])[edges].astype(np.int64)),
                                               pa.py_buffer(letters))
    in_bytes = pa.array([_as_bytes(x).tobytes() for x in np.split(widths, cuts[1:])][:len(cuts)], pa.binary())
    parts_of = pa.StructArray.from_arrays([pa.array(bucket[cuts].astype(np.int32)), spelled.cast(pa.string()), in_bytes,
                                           lists(counts), lists(learnt)], ["bucket", "letters", "widths", "counts", "learnt"])
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(kind))
    sizes = np.concatenate([np.diff(s.splits) for s in parts])
    return pa.record_batch([pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids)),
                            one(np.concatenate(learn), pa.bool_()), one(sizes, pa.int32()),
                            pa.array([(rank[code] & 255).astype(np.uint8).tobytes()], pa.binary()), one(rank[code] >> 8, pa.int32()),
                            one(counts, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(parts_of)], pa.int32()), parts_of)],
                           ["block", "ids", "learn", "sizes", "low", "high", "counts", "parts"])


_BLOCK = ("block long, ids array<long>, learn array<boolean>, sizes array<int>, low binary, high array<int>, counts array<int>, "
          "parts array<struct<bucket:int,letters:string,widths:binary,counts:array<int>,learnt:array<int>>>")


@dataclass
class Packed:
    """``blocks`` (bucketed by block); ``table`` (bucketed by bucket): a row for
    each bucket with its words, and a row (block, places) for each block with
    words there; ``parts``: how many parts the tables by bucket have."""
    blocks: DataFrame
    table: DataFrame
    parts: int


def pack(docs: DataFrame, split: Splitter, block_words: int = BLOCK_WORDS, counts: bool = True) -> Packed:
    """``docs`` (id long, learn boolean, text string) in blocks; the words with
    their counts, unless nobody asks for them."""
    buckets = 1 << max(5, int(np.ceil(np.log2(max(1, docs.count()) / BUCKET_ROWS))))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, made = TaskContext.get().partitionId(), 0
        parts: list[Slice] = []
        ids: list[pa.Array] = []
        learn: list[np.ndarray] = []
        held = 0
        for b in batches(frames, 8 << 20):
            for s in split(b.column(2)):
                if parts and held + len(s.hashes) > block_words:
                    yield _block(parts, ids, learn, task << 32 | made, buckets)
                    parts, ids, learn, held, made = [], [], [], 0, made + 1
                parts.append(s)
                ids.append(b.column(0).slice(s.first, s.rows))
                learn.append(b.column(1).slice(s.first, s.rows).to_numpy(zero_copy_only=False).astype(bool))
                held += len(s.hashes)
        if parts:
            yield _block(parts, ids, learn, task << 32 | made, buckets)

    blocks = bucketed(docs.select("id", "learn", "text").mapInArrow(run, _BLOCK), "block",
                      table_buckets(docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    slices = blocks.select("block", F.inline("parts"))
    if not counts:
        slices = slices.drop("counts", "learnt")
    parts = table_buckets(docs.sparkSession, buckets // 2)
    return Packed(blocks, bucketed(slices.groupBy("bucket").applyInArrow(_placed, _TABLE), "bucket", parts), parts)


def table_buckets(spark: SparkSession, wanted: int) -> int:
    """``wanted``, or the most that a table of Spark's is given."""
    return min(wanted, TABLE_BUCKETS, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` as a table in the shared folder, in ``parts`` buckets by ``key``:
    joins and groupings by it don't shuffle it again."""
    spark, name = df.sparkSession, f"llm_{key}_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(parts, key).option("compression", "zstd")
     .option("path", f"{shared_dir(spark, 'llm')}/{name}").saveAsTable(name))
    return spark.table(name)


def _gathered(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(sizes, all values) of a column of lists."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    return np.diff(lists.offsets.to_numpy()), lists.flatten()


def _ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order (of their bytes), and the place of each given word."""
    coded = words.dictionary_encode()
    order = pa.compute.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


_TABLE = "bucket int, block long, places array<int>, words array<string>, count array<long>, learnt array<long>"


def _placed(key: tuple, t: pa.Table) -> pa.Table:
    """The rows of one bucket: its words, and each block's places among them."""
    sizes, all_words = _words(t["letters"].combine_chunks(), t["widths"])
    words, place = _ordered(all_words)
    total = lambda c: (np.bincount(place, _gathered(t[c])[1].to_numpy(), len(words)).astype(np.int64) if c in t.column_names
                       else np.zeros(len(words), np.int64))
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32)))
    n = len(sizes)
    own = lambda x, kind: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x), pa.nulls(n, pa.list_(kind))])
    return pa.table({
        "bucket": pa.array(np.full(n + 1, key[0].as_py()), pa.int32()),
        "block": pa.concat_arrays([pa.nulls(1, pa.int64()), t["block"].combine_chunks()]),
        "places": pa.concat_arrays([pa.nulls(1, places.type), places]), "words": own(words.cast(pa.string()), pa.string()),
        "count": own(pa.array(total("counts")), pa.int64()), "learnt": own(pa.array(total("learnt")), pa.int64())})


def numbered(packed: Packed, counts: bool = True) -> DataFrame:
    """bucket, word_id and word of each distinct word, and count and learnt
    (with ``counts``); bucketed by bucket."""
    columns = ["words", "count", "learnt"] if counts else ["words"]
    rows = packed.table.where(F.col("block").isNull()).select("bucket", F.posexplode(F.arrays_zip(*columns)).alias("place", "w"))
    word_id = F.shiftleft(F.col("bucket").cast("long"), PLACE_BITS).bitwiseOR(F.col("place").cast("long"))
    return rows.select("bucket", word_id.alias("word_id"), F.col("w.words").alias("word"), *[f"w.{c}" for c in columns[1:]])


#: What ``read_blocks`` needs of a block.
BLOCK_COLUMNS = ("block", "ids", "learn", "sizes", "low", "high", "counts")


def returned(packed: Packed, values: DataFrame, kind: str, pick: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]],
             finish: Callable[[Block, list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """What ``finish`` makes of each block and the values of its words, in its
    order; ``schema`` is its schema.  ``pick`` makes lists (of the schema
    ``kind``) of the values (bucketed by bucket: bucket, word_id, ...; a row for
    each word) at the places of a block's words in a bucket."""
    names, of = zip(*(c.split(" ") for c in kind.split(", ")), strict=True)
    kinds = {"array<int>": pa.int32(), "array<long>": pa.int64(), "array<double>": pa.float64()}

    def at_places(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        sizes, place = _gathered(mine["places"])
        theirs = theirs.combine_chunks()
        theirs = theirs.take(pa.array(np.argsort(theirs["word_id"].to_numpy())))
        made = [pick(theirs, p) for p in np.split(place.to_numpy(), np.cumsum(sizes)[:-1])]
        columns = {n: pa.array([m[n] for m in made], pa.list_(kinds[k])) for n, k in zip(names, of, strict=True)}
        return pa.table({"block": mine["block"], "bucket": mine["bucket"], **columns})

    def of_block(key: tuple, block: pa.Table, back: pa.Table) -> pa.Table:
        back = back.take(pa.array(np.argsort(back["bucket"].to_numpy())))
        flat = [_gathered(back[n])[1].to_numpy() if back.num_rows else np.zeros(0) for n in names]
        return pa.concat_tables([finish(b, flat) for b in read_blocks(block.to_batches())])

    places = packed.table.where(F.col("block").isNotNull()).select("block", "bucket", "places")
    back = places.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(at_places, f"block long, bucket int, {kind}")
    return packed.blocks.select(*BLOCK_COLUMNS).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(of_block, schema)


@dataclass
class Block:
    """A block read back: ids and learn of its texts, ``splits`` of its tokens
    by text, and the ``place`` (by bucket, then as packed) of each token's word."""
    ids: pa.Array
    learn: pa.Array
    splits: np.ndarray
    place: np.ndarray


def read_blocks(frames: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for b in frames:
        for r in range(b.num_rows):
            row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
            counts = row["counts"].values.to_numpy()
            rank = np.frombuffer(row["low"].as_py(), np.uint8) | row["high"].values.to_numpy().astype(np.int64) << 8
            yield Block(row["ids"].values, row["learn"].values, np.concatenate([[0], np.cumsum(row["sizes"].values.to_numpy())]),
                        np.argsort(-counts, kind="stable")[rank])
