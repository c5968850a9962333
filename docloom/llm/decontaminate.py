"""Benchmark decontamination: a broadcast hash set of normalised benchmark
n-grams; document word windows are scanned against it, hits are verified word
by word, and hit spans or contaminated documents are removed.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII
characters.  A window is ``n`` consecutive words of an item; an item of fewer
words, but not none, is one window.  A document word inside any occurrence of
a window is hit; a document is contaminated when ``n_hit > 0`` and
``share * n_hit >= n_words``.

Defined results: null or empty text has no words, no hits and is clean; an
empty benchmark hits nothing; repeated items and repeated document rows each
count as they stand (items are listed once); an item whose id is null still
hits words but is not listed; only ``text`` (and ``item_id``) are read, so
other columns may have any name; they come back unchanged in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved
from .words import ALNUM, Slice, batches, scan, window_hashes

#: Windows that are broadcast at most; beyond it the windows are joined.
BROADCAST_WINDOWS = 1_000_000

_WINDOW = "item_id string, k int, h long, gram string"
_HITS = ("n_words long, n_hit long, items array<string>, "
         "spans array<struct<start:int,end:int>>")


def _gram(s: Slice, i: int, k: int) -> bytes:
    return b" ".join(s.word(j) for j in range(i, i + k))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """One row per distinct (item, window): item_id, length, hash and words."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            ids, out = b.column(0).to_pylist(), ([], [], [], [])
            for s in scan(b.column(1), ALNUM):
                sizes = np.diff(s.splits)
                for k in np.unique(np.minimum(sizes[sizes > 0], n)).tolist():
                    at, h = window_hashes(s, k)
                    rows = np.searchsorted(s.splits, at, "right") - 1
                    for i, r, x in zip(at.tolist(), rows.tolist(), h.view(np.int64).tolist(), strict=True):
                        if k == n or sizes[r] == k:
                            for o, v in zip(out, (ids[s.first + r], k, x, _gram(s, i, k).decode()), strict=True):
                                o.append(v)
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()),
                                   pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                                  ["item_id", "k", "h", "gram"])
    return (benchmark.select(F.col("item_id").cast("string"), "text")
            .mapInArrow(run, _WINDOW).distinct())


def _covered(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs [start, end) of sorted windows, merged."""
    out: list[tuple[int, int]] = []
    for i, k in sorted(found):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], i + k))
        else:
            out.append((i, i + k))
    return out


def _result(rows: list[tuple], names: tuple[str, ...] = ("n_words", "n_hit", "items", "spans")) -> list[pa.Array]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span))
    return [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds[:len(names)])]


def _char_spans(s: Slice, r: int, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs of row r as code point ranges of its text."""
    out = []
    for a, b in runs:
        lo, hi = s.starts[s.splits[r] + a], s.ends[s.splits[r] + b - 1]
        begin = int(((s.text[s.row_at[r]:lo] & 0xC0) != 0x80).sum())
        out.append({"start": begin, "end": begin + int(((s.text[lo:hi] & 0xC0) != 0x80).sum())})
    return out


def find_hits(docs: DataFrame, windows: DataFrame, text: str = "text",
              max_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """``row`` (the whole input row), n_words, n_hit, items (sorted ids of the
    items with occurring windows) and spans (code point ranges of the hits).

    Up to ``max_broadcast`` windows (counted) go to every task as one sorted
    hash array; more are joined with the documents' windows on the hash."""
    windows = saved(windows, "windows")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    if windows.count() > max_broadcast:
        return _joined(whole, windows)
    table: dict[int, dict[int, list[tuple[str, str]]]] = {}
    for w in windows.toLocalIterator():
        table.setdefault(w.k, {}).setdefault(w.h, []).append((w.gram, w.item_id))
    sets = {k: (np.sort(np.array(list(t), np.int64)), t) for k, t in table.items()}
    shared = docs.sparkSession.sparkContext.broadcast(sets)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches(frames):
            rows: list[tuple] = []
            for s in scan(b.column(1), ALNUM):
                found: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for k, (hashes, grams) in known.items():
                    at, h = window_hashes(s, k)
                    h = h.view(np.int64)
                    near = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)]
                    for j in np.flatnonzero(near == h).tolist():
                        gram, i = _gram(s, int(at[j]), k).decode(errors="replace"), int(at[j])
                        r = int(np.searchsorted(s.splits, i, "right")) - 1
                        for known_gram, item in grams[int(h[j])]:
                            if known_gram == gram:
                                found.setdefault(r, []).append((i - int(s.splits[r]), k))
                                items.setdefault(r, set()).add(item)
                for r in range(s.rows):
                    runs = _covered(found.get(r, []))
                    rows.append((int(s.splits[r + 1] - s.splits[r]), sum(y - x for x, y in runs),
                                 sorted(items.get(r, set()) - {None}), _char_spans(s, r, runs)))
            yield pa.record_batch([b.column(0), *_result(rows)], ["row", "n_words", "n_hit", "items", "spans"])

    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, {_HITS}")


def _joined(whole: DataFrame, windows: DataFrame) -> DataFrame:
    """The same result without a broadcast: the documents' windows that occur
    in the benchmark by hash (an equi-join), verified on the words; then one
    row of hits for each distinct text meets the documents again."""
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # n at most

    def grams(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 1 << 20):
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for s in scan(b.column(1), ALNUM):
                for k in lengths:
                    at, h = window_hashes(s, k)
                    rows = np.searchsorted(s.splits, at, "right") - 1
                    words = [_gram(s, i, k).decode(errors="replace") for i in at.tolist()]
                    yield pa.record_batch([pa.array(keys[s.first + rows], pa.int64()), pa.array((at - s.splits[rows]).astype(np.int32)),
                                           pa.array(np.full(len(at), k, np.int32)), pa.array(h.view(np.int64)),
                                           pa.array(words, pa.string())], ["key", "i", "k", "h", "gram"])

    def spans(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            rows: list[tuple] = []
            hit, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            for s in scan(b.column(1), ALNUM):
                for r in range(s.rows):
                    runs = _covered([(x["i"], x["k"]) for x in hit[s.first + r] or []])
                    rows.append((int(s.splits[r + 1] - s.splits[r]), sum(y - x for x, y in runs),
                                 sorted(items[s.first + r] or []), _char_spans(s, r, runs)))
            yield pa.record_batch([b.column(0), *_result(rows)], ["row", "n_words", "n_hit", "items", "spans"])

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = whole.select(key.alias("key"), "text")
    found = (texts.mapInArrow(grams, "key long, i int, k int, h long, gram string")
             .join(windows, ["k", "h", "gram"])
             .groupBy("key").agg(F.collect_set(F.struct("i", "k")).alias("hit"), F.collect_set("item_id").alias("ids")))
    kind = whole.schema["row"].dataType.simpleString()
    return (whole.withColumn("key", key).join(found, "key", "left")
            .select("row", "text", "hit", "ids").mapInArrow(spans, f"row {kind}, {_HITS}"))


def contaminated(share: int = 20) -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20,
                    text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``."""
    return find_hits(docs, benchmark_windows(benchmark, n), text).where(~contaminated(share)).select("row.*")


def cut_spans(hits: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``find_hits`` with the hit spans cut from the text
    (column ``clean_text``; null stays null)."""
    end = F.coalesce(F.try_element_at("spans", F.lit(-1))["end"], F.lit(0))
    body = F.col("row")[text]
    kept = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
                       lambda acc, x: F.struct(F.concat(acc["out"], F.substring(body, acc["at"] + 1, x["start"] - acc["at"])).alias("out"),
                                               x["end"].alias("at")), lambda acc: acc["out"])
    return hits.withColumn("clean_text", F.concat(kept, F.substring(body, end + 1, F.length(body))))
