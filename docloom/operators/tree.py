"""Document order and levels of trees (X1), in as many rounds as the logarithm of
a tree's size.

Each node is two arcs of its tree's Euler tour, one where the walk enters it and
one where it leaves it, and each arc knows the arc before it: what it needs for
that are its parent, its sibling before it, and its last child.  By pointer
jumping every arc then sums up all arcs before it: in each round an arc takes
over the sums and the pointer of the arc that it points to, so its reach
doubles.  Entered nodes before a node are its place in document order; entered
less left ones are its level; entered less left pictures say whether it is
inside one.

Rounds are joins by (document, arc), written to the shared folder; a tree of n
nodes takes log2(2 n) of them, however deep it is.  A node with very many
children and a document with very many nodes are spread over all tasks: siblings
are numbered by ``rank_within``, arcs are dealt by their own key.

Arcs that never reach their tour's start don't end: parents that lead in a
circle, or to a node that isn't there.  They are told by a round in which no
further arc ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .ranks import join_null_safe, rank_within

_SUMS = ("n", "level", "pictures")


def _arcs(nodes: DataFrame) -> DataFrame:
    """doc, node, out (the walk leaves), to_node and to_out (the arc before; null
    at the tour's start) and the sums over that arc alone."""
    ranked = materialized(rank_within(nodes, "order", ["doc", "parent"], "sibling"), "tree-siblings")
    before = ranked.select("doc", "parent", F.col("node").alias("elder"), (F.col("sibling") + 1).alias("sibling"), F.col("picture").alias("elder_picture"))
    placed = join_null_safe(ranked, before, ["doc", "parent", "sibling"], "left")
    parents = ranked.select("doc", F.col("node").alias("parent"), F.col("picture").alias("parent_picture"))
    last = (ranked.where("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("node"))
            .agg(F.max_by(F.struct(F.col("node").alias("last"), F.col("picture").alias("last_picture")), "sibling").alias("child")))
    # what is joined on the left here may be missing: then the arc before isn't there
    entered = placed.join(parents, ["doc", "parent"], "left")
    left = placed.select("doc", "node", "picture").join(last, ["doc", "node"], "left")
    eldest = F.col("sibling") == 0
    one = lambda sign, picture: [F.lit(sign).cast("long"), F.when(picture, sign).otherwise(0).cast("long")]
    enter, leave = one(1, F.col("parent_picture")), one(-1, F.col("elder_picture"))
    start = eldest & F.col("parent").isNull()
    enters = entered.select(
        "doc", "node", F.lit(False).alias("out"), F.when(eldest, F.col("parent")).otherwise(F.col("elder")).alias("to_node"),
        F.when(start, None).otherwise(~eldest).alias("to_out"), F.when(eldest & ~start, 1).otherwise(0).cast("long").alias("n"),
        F.when(start, 0).when(eldest, enter[0]).otherwise(leave[0]).alias("level"),
        F.when(start, 0).when(eldest, enter[1]).otherwise(leave[1]).alias("pictures"))
    leaf = F.col("child").isNull()
    enter, leave = one(1, F.col("picture")), one(-1, F.col("child.last_picture"))
    leaves = left.select(
        "doc", "node", F.lit(True).alias("out"), F.coalesce("child.last", "node").alias("to_node"), (~leaf).alias("to_out"),
        F.when(leaf, 1).otherwise(0).cast("long").alias("n"), F.when(leaf, enter[0]).otherwise(leave[0]).alias("level"),
        F.when(leaf, enter[1]).otherwise(leave[1]).alias("pictures"))
    return enters.unionByName(leaves)


def tour_sums(arcs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, node, out and the sums over all arcs before, of the arcs that reach
    their tour's start; rounds taken)."""
    every = materialized(arcs, "tree-arcs")
    waiting, rounds = every.where("to_out IS NOT NULL").count(), 0
    while waiting:
        rounds += 1
        beyond = every.select("doc", F.col("node").alias("to_node"), F.col("out").alias("to_out"), F.col("to_node").alias("next_node"),
                              F.col("to_out").alias("next_out"), *[F.col(c).alias(f"more_{c}") for c in _SUMS])
        jumped = (every.where("to_out IS NOT NULL").join(beyond, ["doc", "to_node", "to_out"])
                  .select("doc", "node", "out", F.col("next_node").alias("to_node"), F.col("next_out").alias("to_out"),
                          *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in _SUMS]))
        every = materialized(every.where("to_out IS NULL").unionByName(jumped), "tree-arcs")
        left = every.where("to_out IS NOT NULL").count()
        if left == waiting:
            break  # what is left goes round in circles
        waiting = left
    return every.where("to_out IS NULL").select("doc", "node", "out", *_SUMS), rounds


def document_order(nodes: DataFrame, doc: str = "doc_id", node: str = "node_id", parent: str = "parent_id", order: str = "node_no",
                   kind: str = "kind", picture: str = "picture", name: str = "preorder") -> DataFrame:
    """``nodes`` with ``preorder`` (the place in document order, from 0 in
    each document), ``level`` (0 at a root), ``under_picture`` (some ancestor is
    a picture) and ``reached``.

    Siblings, and the roots of a document, follow each other by ``order`` (ties
    by node id).  Ids are unique in a document and not null.  Nodes whose parents
    lead to no root (a circle, or a parent that isn't there) aren't reached: the
    first three are null.  An empty table gives an empty result."""
    rows = nodes.select(F.col(doc).alias("doc"), F.col(node).alias("node"), F.col(parent).alias("parent"),
                        F.struct(F.col(order), F.col(node)).alias("order"), F.coalesce(F.col(kind) == picture, F.lit(False)).alias("picture"))
    sums, _ = tour_sums(_arcs(rows))
    found = sums.where("NOT out").select(F.col("doc").alias(doc), F.col("node").alias(node), F.col("n").alias(name), F.col("level").cast("int").alias("level"),
                                         (F.col("pictures") > 0).alias("under_picture"), F.lit(True).alias("reached"))
    return nodes.join(found, [doc, node], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
