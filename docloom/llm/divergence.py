"""Source divergence audit by a token-start pointer sort.

Terms are runs of Latin letters and non-ASCII characters, A-Z lower-cased.  Each
task takes its rows in shards of bounded size; in a shard the rows stand in
order of (language, source), and one pointer into the Arrow text buffer stands
for each term's start.  The pointers, not the terms, are sorted, by a multikey
quicksort of eight bytes at a time that keeps equal terms in the order of the
text.  So an equal run is a term, a stretch of one source in it is the term's
count there, and the changes of row in it are its document frequency.

1. Shards give (language, source, term, occurrences, documents), which Spark
   sums up before and after its shuffle: no task sees a language or a source
   whole.
2. A language keeps the terms in at least ``least`` of its documents.
3. A share ``1 + floor(10**9 (count + 5) / (N + 5 V))`` stands for each term in a
   source and in its language; all of it in integers.
4. ``pair``: the distance of two sources is a sum over the kept terms.  Terms are
   dealt by hash to shards and sources to blocks of ``BLOCK``; each shard holds a
   matrix of its terms by sources and sums up differences beyond those that two
   absent counts make, so absent terms need no rows.
5. ``term``: the terms by which a source stands out of its language.

Defined results: null text, language or source is read as ''; every (language,
source) that occurs has pairs, also without terms (at value 0 if its language
keeps none); each row is a document, repeated ids or rows too; ties go by the
item's bytes; long texts and long terms are taken whole; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved
from .words import ALNUM, LOWER, batches, joined

#: Letters a-z and every byte of a non-ASCII character.
TERM = ALNUM & ~((np.arange(256) >= 48) & (np.arange(256) <= 57))
#: A term is kept in at least so many documents; smoothing; the scale of a share.
LEAST, SMOOTH, SCALE = 30, 5, 10**9
#: Terms reported for each source.
TOP = 50
#: Bytes of text in a shard of pointers (one text at least).
SHARD = 8 << 20
#: Pointers of one segment that are sorted at once.
SEGMENT = 1 << 15
#: Sources in a block, and (term, source) counts in a shard of the distances, about
#: (as many as the language has pairs of sources, if they are more).
BLOCK, CELLS = 256, 50_000
#: Terms of a matrix held at once.
MATRIX_TERMS = 4096


def _keys(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each term as a number, zeros beyond its end."""
    spare = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
    whole = view[at].astype(np.uint64)
    half = spare >> np.uint64(1)  # two shifts: 64 in one is undefined
    return (whole >> half >> (spare - half)) << half << (spare - half)


def pointer_sort(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): pointers in order of their terms, equal terms in the given
    order, and whether each differs from the one before.

    Multikey quicksort: a segment's pointers agree in their first ``depth``
    bytes; a large one is split in three by the next eight bytes of a pivot, and
    the middle part goes on eight bytes further; small ones are sorted by those
    bytes, all of a depth together."""
    n = len(starts)
    order = np.arange(n)
    new = np.zeros(n, bool)
    if not n:
        return order, new
    new[0] = True
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))
    todo, depth = [(0, n)], 0
    while todo:
        small, deeper = [], []
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= segment:
                small.append((lo, hi))
                continue
            own = order[lo:hi]
            key = _keys(view, starts[own] + depth, lengths[own] - depth)
            some = np.sort(key[::len(key) // 63 + 1])
            pivot = some[len(some) // 2]
            less, more = key < pivot, key > pivot
            same = ~(less | more)
            a, b = lo + int(less.sum()), hi - int(more.sum())
            order[lo:hi] = np.concatenate([own[less], own[same], own[more]])
            new[[x for x in (a, b) if lo < x < hi]] = True
            if a > lo:
                todo.append((lo, a))
            if hi > b:
                todo.append((b, hi))
            if int(pivot) & 255:  # else the terms end here
                deeper.append((a, b))
        if small:
            deeper += _sort_small(view, starts, lengths, order, new, depth, np.array(sorted(small)))
        todo, depth = [(lo, hi) for lo, hi in deeper if hi - lo > 1], depth + 8
    return order, new


def _sort_small(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int,
                segments: np.ndarray) -> list[tuple[int, int]]:
    """Sorts segments by the eight bytes at ``depth``; gives the runs of equal
    bytes whose terms go on."""
    sizes = segments[:, 1] - segments[:, 0]
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(sizes.sum()) - begins[of] + segments[of, 0]
    own = order[places]
    key = _keys(view, starts[own] + depth, lengths[own] - depth)
    by = np.lexsort((key, of)) if len(sizes) > 1 else np.argsort(key, kind="stable")
    order[places], key = own[by], key[by]
    change = np.ones(len(key), bool)
    change[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    new[places[change]] = True
    run = np.flatnonzero(change)
    ends = np.append(run[1:], len(key))
    on = ((key[run] & np.uint64(255)) != 0) & (ends - run > 1)
    return list(zip(places[run[on]].tolist(), (places[ends[on] - 1] + 1).tolist(), strict=True))


def _shard(text: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, start, length, occurrences, documents) of each term of each group
    of a shard whose rows stand in order of their groups."""
    inside = np.concatenate([[False], TERM[text], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    order, new = pointer_sort(text, starts, lengths)
    if not len(order):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    row = (np.searchsorted(bounds, starts, "right") - 1)[order]
    of = group[row]
    new[1:] |= of[1:] != of[:-1]
    document = new.copy()
    document[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    return (of[first], starts[order[first]], lengths[order[first]], np.diff(np.append(first, len(order))),
            np.add.reduceat(document.astype(np.int64), first))


_COUNTED = "lang string, source string, term string, n long, docs long"


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of ``docs`` (lang, source,
    text), summed up."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, SHARD):
            langs, sources = (b.column(i).dictionary_encode() for i in range(2))
            code = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            order = np.argsort(code, kind="stable")
            group_of = code[order]
            texts = b.column(2).take(pa.array(order))
            for row, text, bounds in joined(texts, LOWER, SHARD):
                of, at, size, n, documents = _shard(text, bounds, group_of[row:row + len(bounds) - 1])
                ends = np.cumsum(size)
                letters = text[np.arange(size.sum()) - np.repeat(ends - size - at, size)]
                terms = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(letters))
                source_row = pa.array(first[of])
                yield pa.record_batch([b.column(0).take(source_row), b.column(1).take(source_row), terms.cast(pa.string()),
                                       pa.array(n, pa.int64()), pa.array(documents, pa.int64())], ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale (count + smooth) / (total + smooth kept)), in exact
    integers: a product beyond 64 bits is a decimal."""
    over = (F.lit(scale).cast("decimal(10,0)") * (count + smooth).cast("decimal(20,0)"))
    under = (total + F.lit(smooth) * kept).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, F.nullif(under, F.lit(0).cast("decimal(20,0)")))




def _distances(key: tuple, rows: pa.Table, width: int, at_once: int) -> pa.Table:
    """Of each two sources of two blocks (of ``width``): the sum over a shard's
    terms of the difference of their shares, less that of their shares of absent
    terms; a matrix holds ``at_once`` terms."""
    lang, _, low, high = (x.as_py() for x in key)
    g, p, term = rows["g"].to_numpy(), rows["p"].to_numpy(), rows["term"].combine_chunks()
    absent = term.is_null().to_numpy(zero_copy_only=False)
    bases, sides = [], []
    for block in (low, high):
        own = np.flatnonzero(absent & (g // width == block))
        own = own[np.argsort(g[own])]
        bases.append((g[own], p[own]))
        sides.append(np.flatnonzero(~absent & (g // width == block)))
    coded = term.dictionary_encode()
    code = coded.indices.fill_null(0).to_numpy().astype(np.int64)
    total = np.zeros((len(bases[0][0]), len(bases[1][0])), np.int64)
    alone = np.abs(bases[0][1][:, None] - bases[1][1][None, :])
    for first in range(0, len(coded.dictionary), at_once):
        many = min(at_once, len(coded.dictionary) - first)
        x, y = (np.tile(base, (many, 1)) for _, base in bases)
        for matrix, (names, _), side in ((x, bases[0], sides[0]), (y, bases[1], sides[1])):
            here = side[(code[side] >= first) & (code[side] < first + many)]
            matrix[code[here] - first, np.searchsorted(names, g[here])] = p[here]
        for i in range(x.shape[1]):
            total[i] += np.abs(x[:, i:i + 1] - y).sum(0)
        total -= many * alone
    i, j = np.nonzero(np.triu(np.ones_like(total, bool), 1) if low == high else np.ones_like(total, bool))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(bases[0][0][i], pa.int32()),
                     "j": pa.array(bases[1][0][j], pa.int32()), "excess": pa.array(total[i, j], pa.int64())})


def _pairs(cells: DataFrame, groups: DataFrame, width: int, at_once: int) -> DataFrame:
    """lang, source, item, value of each two sources of a language."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / width))).alias("other")
    block = F.floor(F.col("g") / width)
    keys = [F.least(block, "other").alias("low"), F.greatest(block, "other").alias("high")]
    present = (cells.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), other, "term", "g", "p")
               .select("lang", "shard", *keys, "term", "g", "p"))
    absent = (groups.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "sources", "g", "base")
              .select("lang", "shard", other, "g", "base").select("lang", "shard", *keys, F.lit(None).cast("string").alias("term"), "g", F.col("base").alias("p")))
    summed = (present.unionByName(absent).groupBy("lang", "shard", "low", "high")
              .applyInArrow(lambda key, rows: _distances(key, rows, width, at_once), "lang string, i int, j int, excess long").groupBy("lang", "i", "j").agg(F.sum("excess").alias("excess")))
    both = summed.select("lang", F.inline(F.array(F.struct(F.col("i").alias("g"), F.col("j").alias("h")), F.struct(F.col("j").alias("g"), F.col("i").alias("h")))), "excess")
    one = groups.select("lang", "source", "g", "base", "kept")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("base").alias("item_base"))
    # the result itself: each other source of a source's language
    return (one.join(two, "lang").where("g <> h").join(both, ["lang", "g", "h"], "left")
            .select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * F.abs(F.col("base") - F.col("item_base")) + F.coalesce("excess", F.lit(0)))
                    .otherwise(F.lit(0)).cast("long").alias("value")))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, smooth: int = SMOOTH,
          scale: int = SCALE, top: int = TOP, block: int = BLOCK, cells: int = CELLS, matrix: int = MATRIX_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank (from 1 for each language,
    source and part, greatest value first); ``block``, ``cells`` and ``matrix``
    bound what a task of the distances holds, and don't change the result."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = saved(counted_terms(rows), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    found = saved(counts.join(kept.select("lang", "term", "all_n"), ["lang", "term"]), "kept")

    of_lang = (found.groupBy("lang", "term").agg(F.first("all_n").alias("all_n"), F.count(F.lit(1)).alias("cells"))
               .groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_total"), F.sum("cells").alias("cells")))
    of_source = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_source = Window.partitionBy("lang").orderBy("source")
    numbered = (rows.select("lang", "source").distinct()
                .withColumn("g", F.row_number().over(by_source) - 1).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))))
    zero = F.lit(0).cast("long")
    groups = (numbered.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
              .select("lang", "source", "g", "sources", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"),
                      F.coalesce("lang_total", zero).alias("lang_total"), (F.floor(F.coalesce("cells", zero) / F.greatest(F.lit(cells), F.col("sources") * F.col("sources"))) + 1).alias("shards")))
    groups = saved(groups.withColumn("base", _share(zero, F.col("total"), F.col("kept"), smooth, scale)), "sources")
    shares = (found.join(groups, ["lang", "source"])
              .withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept"), smooth, scale))
              .withColumn("q", _share(F.col("all_n"), F.col("lang_total"), F.col("kept"), smooth, scale)))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(shares, groups, block, matrix).withColumn("rank", F.row_number().over(ranked))
    terms = (shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
