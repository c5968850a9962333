"""SentencePiece encoding and decoding by a relational lattice.

The distinct words of the corpus (see ``lexicon``) are exploded into their
substrings of at most the longest piece's length; an equi-join with the piece
table leaves the edges of each word's lattice; they are grouped by word, and a
fold (Spark's ``aggregate``) over the edges by end keeps the best path to each
place: Viterbi.  The ids go back to the documents' blocks.

A blank is put before the text, and blanks are written ``▁``.  A word starts
at each line feed and, with ``run_words``, at the first blank of a run (the
queries): no piece crosses a word's start, so the best path of a text is made
of its words' best paths.  With ``spaced_words``, the default of ``encode``, it
starts at each blank, and pieces of several blanks aren't used.  A character without a piece of its
own costs the least piece's score and ``UNKNOWN_PENALTY``, and is written as
the pieces of its bytes (also a ``▁`` of the text itself), so decoding gives
back every text.  Of paths of equal score the one whose last piece starts
first is taken.

Defined results: null and empty text have no ids, and decode to the empty text;
long words are exploded whole, and folded in time about linear in them; repeated rows and null ids keep rows of their
own; only id and text are read, so other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepairs import _binary, _flat
from .lexicon import BLOCK_COLUMNS, Block, Splitter, bucketed, numbered, pack, read_blocks, spaced_words
from .pieces import MODEL_FILE, UNKNOWN_PENALTY, byte_ids, load_pieces, piece_table

#: Vocabularies of more pieces aren't broadcast by hint.
BROADCAST_PIECES = 1_000_000


def _written(word: Column) -> Column:
    """Blanks as ``▁``, and the other way round: no piece has a blank."""
    return F.translate(word, " ▁", "▁ ")


#: Characters of a word that are cut out at once, so that substrings of a long
#: word aren't counted from its start each time.
PART = 1024

#: An edge's key is one number, by which a word's edges sort by end, then
#: start: end, 63 - size and id, with so many bits for the last two.
_SIZE_BITS, _ID_BITS = 6, 32
_LEAST_ID = -(1 << 21)


def _edge(start: Column, size: Column, id: Column) -> Column:
    end = F.shiftleft((start + size).cast("long"), _SIZE_BITS + _ID_BITS)
    return end + F.shiftleft((F.lit(63) - size).cast("long"), _ID_BITS) + (id - F.lit(_LEAST_ID)).cast("long")


def _parts_of(key: Column) -> tuple[Column, Column]:
    """(size, id) of an edge, from its key's lower bits."""
    size = F.lit(63) - F.shiftright(key, _ID_BITS).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return size, (key.bitwiseAND(F.lit((1 << _ID_BITS) - 1)) + F.lit(_LEAST_ID).cast("long")).cast("int")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """bucket, word_id, edges: the edges (key, score) of each word's lattice,
    sorted by key.  A character c without a piece is an edge too, with the id -c - 1.
    Words that are bucketed by bucket aren't shuffled: join and grouping stay
    where they are."""
    if longest >= 64:
        raise ValueError(f"a piece has {longest} characters; 63 is the most")
    written = words.select("bucket", "word_id", _written(F.col("word")).alias("word"))
    parts = (written.select("bucket", "word_id", "word", F.length("word").alias("n"),
                            F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(PART))).alias("from"))
             .select("bucket", "word_id", "from", F.least(F.lit(PART), F.col("n") - F.col("from")).alias("n"),
                     F.substring("word", F.col("from") + 1, F.lit(PART + longest)).alias("part")))
    starts = (parts.select("bucket", "word_id", "from", "part", F.explode(F.sequence(F.lit(1), "n")).alias("at"))
              .select("bucket", "word_id", (F.col("from") + F.col("at") - 1).alias("start"), F.substring("part", F.col("at"), F.lit(longest)).alias("rest")))
    spans = (starts.select("bucket", "word_id", "start", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("size"))
             .select("bucket", "word_id", "start", "size", F.substring("rest", F.lit(1), F.col("size")).alias("piece")))
    key = _edge(F.col("start"), F.col("size"), F.coalesce("id", -F.ascii(_written(F.col("piece"))) - 1))
    edges = (spans.join(pieces, "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
             .select("bucket", "word_id", key.alias("key"), F.coalesce("score", F.lit(unknown)).alias("score")))
    return (edges.groupBy("word_id", "bucket").agg(F.collect_list(F.struct("key", "score")).alias("edges"))
            .select("bucket", "word_id", F.sort_array("edges").alias("edges")))


def viterbi(edges: Column) -> Column:
    """The ids of the path of greatest score over a word's edges.  The fold
    keeps the best score and ids to each place reached, in order; an edge goes
    to the newest place or the next."""
    cell = lambda score, ids: F.struct(score.alias("score"), ids.alias("ids"))
    start_cell = F.array(cell(F.lit(0.0), F.array().cast("array<int>")))

    def step(best: Column, edge: Column) -> Column:
        key = edge["key"]
        end = F.shiftright(key, _SIZE_BITS + _ID_BITS).cast("int")
        size, id = _parts_of(key)
        back = F.get(best, end - size)
        total = back["score"] + edge["score"]
        new = cell(total, F.array_append(back["ids"], id))  # appending costs less than concat
        return (F.when(end == F.size(best), F.array_append(best, new))
                .when(total > F.get(best, end)["score"], F.array_append(F.slice(best, F.lit(1), end), new))
                .otherwise(best))

    return F.aggregate(edges, start_cell, step, lambda best: F.element_at(best, -1)["ids"])


#: Edges of a word beyond which its fold is nested; edges of an inner fold.  Spark
#: copies a fold's state at each step, so the inner state is kept small.
LONG, INNER = 200, 256


def _in_parts(n: Column, start: Column, step: Callable[[Column, Column], Column], taken: Callable[[Column], Column]) -> Column:
    """A fold of ``step`` over 0 .. n - 1 by parts of ``INNER``: ``step`` gets a
    state with a list ``out``, which begins each part empty; the lists of the
    parts are joined, and ``taken`` makes the last state's values the end."""
    empty = F.array().cast("array<bigint>")

    def part(s: Column, first: Column) -> Column:
        begun = s["state"].withField("out", empty)
        done = F.aggregate(F.sequence(first, F.least(first + (INNER - 1), n - 1)), begun, step)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(
            d.alias("state"), F.concat(s["lists"], F.array(d["out"])).alias("lists"))), 1)

    zero = F.struct(start.alias("state"), F.array().cast("array<array<bigint>>").alias("lists"))
    return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(INNER)), zero, part,
                       lambda s: F.concat(F.flatten(s["lists"]), taken(s["state"])))


def long_viterbi(edges: Column, longest: int) -> Column:
    """``viterbi`` for words of many edges: the fold keeps the scores of the last
    ``longest`` places and, for each place, the last edge of its best path; a
    second fold goes back over these."""
    none = F.array().cast("array<bigint>")
    mask = F.lit((1 << (_SIZE_BITS + _ID_BITS)) - 1)

    def cell(*x: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(x, ("at", "scores", "newest", "out"), strict=True)])

    def step(s: Column, i: Column) -> Column:
        edge = F.get(edges, i)
        end = F.shiftright(edge["key"], _SIZE_BITS + _ID_BITS).cast("int")
        scores, many = s["scores"], F.size(s["scores"])
        total = F.get(scores, many - 1 + (end - s["at"]) - _parts_of(edge["key"])[0]) + edge["score"]
        back = edge["key"].bitwiseAND(mask)
        kept = F.slice(scores, F.greatest(F.lit(1), many + 2 - F.lit(longest)), F.lit(longest))
        return (F.when(end > s["at"], cell(end, F.concat(kept, F.array(total)), back, F.concat(s["out"], F.array(s["newest"]))))
                .when(total > F.element_at(scores, -1),
                      cell(end, F.concat(F.slice(scores, F.lit(1), many - 1), F.array(total)), back, s["out"]))
                .otherwise(s))

    start = cell(F.lit(0), F.array(F.lit(0.0)), F.lit(0).cast("bigint"), none)
    # the first is that of place 0, which has no edge: the way back ends before it
    backs = F.reverse(_in_parts(F.size(edges), start, step, lambda s: F.array(s["newest"])))

    def ids(b: Column) -> Column:
        def trace(s: Column, i: Column) -> Column:
            size, id = _parts_of(F.get(b, i))
            return (F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), s["out"].alias("out")))
                    .otherwise(F.struct((size - 1).alias("skip"), F.concat(s["out"], F.array(id.cast("bigint"))).alias("out"))))

        return F.reverse(_in_parts(F.size(b) - 1, F.struct(F.lit(0).alias("skip"), none.alias("out")), trace, lambda _: none))

    return F.element_at(F.transform(F.array(backs), ids), 1).cast("array<int>")


def word_ids(words: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """bucket, word_id, ids of each distinct word (bucket, word_id, word); a
    character c without a piece is -c - 1."""
    rows = load_pieces(model_file)
    pieces = piece_table(words.sparkSession, rows)
    longest, unknown = max(len(p) for _, p, _ in rows), min(s for _, _, s in rows) - UNKNOWN_PENALTY
    if len(rows) <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    edges = F.col("edges")
    ids = F.when(F.size(edges) <= LONG, viterbi(edges)).otherwise(long_viterbi(edges, longest))
    return lattice(words, pieces, longest, unknown).select("bucket", "word_id", ids.alias("ids"))


def _by_bytes(many: np.ndarray, ids: np.ndarray, bytes_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids (sizes and values) with each -c - 1 as the pieces of c's bytes."""
    lacking = np.flatnonzero(ids < 0)
    if not len(lacking):
        return many, ids
    spelled = [bytes_of[list(chr(-i - 1).encode())] for i in ids[lacking].tolist()]
    width = np.ones(len(ids), np.int64)
    width[lacking] = [len(x) for x in spelled]
    out = np.repeat(ids, width)
    ends = np.cumsum(width)
    for at, x in zip(lacking.tolist(), spelled, strict=True):
        out[ends[at] - len(x):ends[at]] = x
    cuts = np.concatenate([[0], np.cumsum(many)])
    return np.diff(np.concatenate([[0], ends])[cuts]), out


#: Tokens whose ids are put together at once.
_AT_ONCE = 200_000


def _flagged(kind: np.dtype) -> np.number:
    """The highest bit of a number: it marks a word's last id on the way back."""
    return kind.type(1 << (8 * kind.itemsize - 1))


def _encoded_rows(block: Block, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, ids) of each text of a block, from the ids of its words."""
    mark = _flagged(values.dtype)
    ends = np.flatnonzero(values & mark) + 1
    begins = np.concatenate([[0], ends])
    many = np.diff(begins)
    first, last = 0, len(block.splits) - 1
    while first < last:
        stop = int(np.searchsorted(block.splits, block.splits[first] + _AT_ONCE, "right")) - 1
        stop = min(last, max(first + 1, stop))
        at = block.place[block.splits[first]:block.splits[stop]]
        cuts = np.concatenate([[0], np.cumsum(many[at])]).astype(np.int64)
        out = values[np.arange(cuts[-1]) - np.repeat(cuts[:-1] - begins[at], many[at])] & ~mark if len(at) else values[:0]
        lists = pa.ListArray.from_arrays(pa.array(cuts[block.splits[first:stop + 1] - block.splits[first]].astype(np.int32)),
                                         pa.array(out.astype(np.int32)))
        yield pa.record_batch([block.ids.slice(first, stop - first), lists], ["id", "ids"])
        first = stop


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE,
           words: Splitter = spaced_words, also: dict[str, Callable[[pa.Array], pa.Array]] | None = None) -> DataFrame:
    """id_col and ids (the pieces of the whole text, cut into ``words``) of each
    row; ``also``: further columns of bytes, by functions of lists of ids such as
    ``piece_bytes``, made where the ids are put together, so that they take no
    second way through Python."""
    also = also or {}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("learn"), F.col(text).cast("string").alias("text"))
    packed = pack(rows, words, counts=False)
    ids = bucketed(word_ids(numbered(packed, counts=False), model_file), "bucket", packed.parts)
    bytes_of = np.array(byte_ids(model_file))
    kind = np.dtype(np.uint16 if max(*bytes_of, *(i for i, _, _ in load_pieces(model_file))) < 1 << 15 else np.uint32)

    def pick(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The ids of each block's words in the bucket, a word's last one marked."""
        lists = theirs.combine_chunks()["ids"].combine_chunks().take(pa.array(np.argsort(theirs["word_id"].to_numpy())))
        sent = []
        for places in mine["places"].to_pylist():
            own = lists.take(pa.array(places, pa.int64()))
            many, values = _by_bytes(np.diff(own.offsets.to_numpy()), own.flatten().to_numpy(), bytes_of)
            values = values.astype(kind)
            values[np.cumsum(many) - 1] |= _flagged(kind)
            sent.append(values.tobytes())
        return pa.table({"block": mine["block"], "bucket": mine["bucket"], "sent": pa.array(sent, pa.binary())})

    def finish(key: tuple, block: pa.Table, back: pa.Table) -> pa.Table:
        back = back.take(pa.array(np.argsort(back["bucket"].to_numpy())))
        values = np.frombuffer(b"".join(back["sent"].to_pylist()), kind)
        parts = [pa.record_batch([*b.columns, *[made(b.column(1)) for made in also.values()]], ["id", "ids", *also])
                 for one in read_blocks(block.to_batches()) for b in _encoded_rows(one, values)]
        return pa.Table.from_batches(parts, pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), *[(c, pa.binary()) for c in also]]))

    places = packed.table.where(F.col("block").isNotNull()).select("block", "bucket", "places")
    back = places.groupBy("bucket").cogroup(ids.groupBy("bucket")).applyInArrow(pick, "block long, bucket int, sent binary")
    blocks = packed.blocks.select(*BLOCK_COLUMNS)
    schema = ", ".join(["id long, ids array<int>", *[f"`{c}` binary" for c in also]])
    return (blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)
            .withColumnRenamed("id", id_col))


def piece_bytes(spark: SparkSession, model_file: str = MODEL_FILE) -> Callable[[pa.Array], pa.Array]:
    """A function of lists of ids: the text they stand for, in UTF-8, by a join
    with the table of the pieces' bytes (broadcast: as large as the vocabulary):
    pieces joined, ``▁`` as blanks, byte pieces as bytes, the first blank
    dropped.  A null list gives null."""
    table = {i: p.replace("▁", " ").encode() for i, p, _ in load_pieces(model_file)} | {i: bytes([b]) for b, i in enumerate(byte_ids(model_file))}
    shared = spark.sparkContext.broadcast(pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary()))

    def decoded(lists: pa.Array) -> pa.Array:
        cuts, ids = _flat(lists)
        taken = shared.value.take(pa.array(ids))
        if taken.null_count:
            raise ValueError(f"ids that stand for no piece: {np.unique(ids[taken.is_null().to_numpy(zero_copy_only=False)])[:10].tolist()}")
        _, offsets, data = taken.buffers()
        text = np.frombuffer(data or b"", np.uint8)
        ends = np.frombuffer(offsets, np.int64)[taken.offset + cuts]
        some = ends[1:] > ends[:-1]
        keep = np.ones(ends[-1], bool)
        keep[ends[:-1][some]] = False
        return _binary(lists, ends - np.concatenate([[0], np.cumsum(some)]), pa.py_buffer(text[:ends[-1]][keep]))
    return decoded


def decode(encoded: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """``encoded`` with ``text``: what its ids stand for (see ``piece_bytes``);
    bytes that are no UTF-8 are replaced.  Null ids give null."""
    decoded = piece_bytes(encoded.sparkSession, model_file)
    whole = encoded.select(F.struct(*[encoded[c] for c in encoded.columns]).alias("row"), encoded[ids].alias("ids"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = decoded(b.column(1))
            try:
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([None if x is None else x.decode(errors="replace") for x in texts.to_pylist()], pa.string())
            yield pa.record_batch([b.column(0), texts], ["row", "decoded"])

    return (whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, decoded string")
            .select("row.*", F.col("decoded").alias("text")))
