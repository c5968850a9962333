"""Edit-aware token counts: each document keeps a segment tree over runs of
pre-tokens; an edit re-encodes only the runs it touches and the context around
them, and updates the sums above.

Leaves are runs of pre-tokens of about ``LEAF_CHARS`` characters, cut before a
single blank between two characters that aren't white space: there a pre-token
always starts, whatever stands on either side, so the counts of leaves add up
to the count of the text.  A tree holds per leaf its characters and tokens, and
per inner node (``FAN`` children) their sums; an edit finds its leaves from the
root, replaces them by re-encoded ones, and sums up the path again.

Edits are (pos, removed, inserted): at code point ``pos`` so many code points
go and ``inserted`` comes.  Edits of a document are applied in order of ``seq``.

Defined results: null text counts as empty (no leaf, 0 tokens); positions and
lengths are cut to the text, and null parts of an edit count as 0 or '';
a document without edits keeps its count; edits of unknown or null ids are
ignored; repeated documents each get their id's edits; a text without a place
to cut is one leaf; only the named columns are read; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batches

#: The public vocabulary and its pre-token pattern; both are parameters.
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-token pattern of that vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS, FAN = 128, 16
_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def _encoder(ranks_file: str, pattern: str):
    import tiktoken
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, size: int = LEAF_CHARS) -> list[str]:
    """``text`` in runs of whole pre-tokens, each of ``size`` characters or little more."""
    out, last = [], 0
    while last < len(text):
        m = _CUT.search(text, last + size)
        end = m.start() if m else len(text)
        out.append(text[last:end])
        last = end
    return out


class Tree:
    """Levels of (characters, tokens), leaves first; the last has one node."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.levels = [list(leaves)]
        self._sum_up()

    def _sum_up(self) -> None:
        del self.levels[1:]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([(sum(x[0] for x in below[i:i + FAN]), sum(x[1] for x in below[i:i + FAN]))
                                for i in range(0, len(below), FAN)])

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1] if self.levels[-1] else 0

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf, its first character) that holds character ``pos``, from the root."""
        at, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            at *= FAN
            last = min(at + FAN, len(level)) - 1
            while at < last and begin + level[at][0] <= pos:
                begin += level[at][0]
                at += 1
        return at, begin

    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Put ``leaves`` in place of leaves first .. last; as many of them
        change only the sums on the way up."""
        self.levels[0][first:last + 1] = leaves
        if len(leaves) != last + 1 - first:
            self._sum_up()
            return
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            first, last = first // FAN, last // FAN
            for i in range(first, last + 1):
                part = below[i * FAN:(i + 1) * FAN]
                level[i] = (sum(x[0] for x in part), sum(x[1] for x in part))


def grow(text: str, count) -> Tree:
    return Tree([(len(x), count(x)) for x in cut(text)])


def edit(text: str, tree: Tree, pos: int, removed: int, inserted: str, count) -> tuple[str, int]:
    """The edited text, with ``tree`` made to match; how many characters were
    encoded anew: the touched leaves and one more to each side, whose ends are
    places where a pre-token starts in the new text too."""
    pos = min(max(pos, 0), len(text))
    end = min(len(text), pos + max(removed, 0))
    if pos == end and not inserted:
        return text, 0
    new = text[:pos] + inserted + text[end:]
    if not tree.levels[0]:
        tree.replace(0, -1, [(len(x), count(x)) for x in cut(new)])
        return new, len(new)
    first, begin = tree.find(max(pos - 1, 0))
    last, start = tree.find(max(end, pos))
    stop = start + tree.levels[0][last][0]
    # one leaf of context to each side: the cuts there stand clear of the edit
    if first:
        first -= 1
        begin -= tree.levels[0][first][0]
    if last + 1 < len(tree.levels[0]):
        last += 1
        stop += tree.levels[0][last][0]
    part = new[begin:stop + len(new) - len(text)]
    tree.replace(first, last, [(len(x), count(x)) for x in cut(part)])
    return new, len(part)


_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def _count_with(ranks_file: str, pattern: str):
    encoder = _encoder(ranks_file, pattern)
    return lambda x: len(encoder.encode_ordinary(x))


def build_trees(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks_file: str = RANKS_FILE,
                pattern: str = PATTERN) -> DataFrame:
    """id_col, text, n_tokens and tree: the leaves (chars, tokens), from which
    the inner sums follow."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _count_with(ranks_file, pattern)
        for b in batches(frames):
            trees = [grow(t, count) for t in b.column(1).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([t.tokens for t in trees], pa.int64()), pa.array(
                [{"chars": [x[0] for x in t.levels[0]], "tokens": [x[1] for x in t.levels[0]]} for t in trees], _TREE)],
                ["id", "text", "n_tokens", "tree"])

    return (rows.mapInArrow(run, "id long, text string, n_tokens long, tree struct<chars:array<int>,tokens:array<int>>")
            .withColumnsRenamed({"id": id_col, "text": text}))


def apply_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", text: str = "text",
                ranks_file: str = RANKS_FILE, pattern: str = PATTERN) -> DataFrame:
    """``trees`` after ``edits`` (id_col, seq, pos, removed, inserted), with
    n_before and n_encoded (characters that were encoded anew).  A document's
    edits are one list: as many as it has."""
    listed = (edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("of")).agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), F.coalesce("removed", F.lit(0)).cast("int").alias("removed"),
        F.coalesce("inserted", F.lit("")).alias("inserted")))).alias("edits")))
    both = trees.join(listed, trees[id_col] == listed["of"], "left").select(id_col, text, "n_tokens", "tree", F.col("edits"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _count_with(ranks_file, pattern)
        for b in batches(frames):
            texts, tokens, leaves, encoded = [], [], [], []
            for t, leaf, todo in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                tree = Tree(list(zip(leaf["chars"], leaf["tokens"], strict=True)))
                anew = 0
                for e in todo or ():
                    t, n = edit(t, tree, e["pos"], e["removed"], e["inserted"], count)
                    anew += n
                texts.append(t)
                tokens.append(tree.tokens)
                leaves.append({"chars": [x[0] for x in tree.levels[0]], "tokens": [x[1] for x in tree.levels[0]]})
                encoded.append(anew)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(tokens, pa.int64()), pa.array(leaves, _TREE),
                                   b.column(2), pa.array(encoded, pa.int64())],
                                  ["id", "text", "n_tokens", "tree", "n_before", "n_encoded"])

    return (both.mapInArrow(run, "id long, text string, n_tokens long, tree struct<chars:array<int>,tokens:array<int>>, "
                                 "n_before long, n_encoded long")
            .withColumnsRenamed({"id": id_col, "text": text}))
