"""Trees in document order: against a plain walk; chains, wide nodes, circles."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import tree

SCHEMA = "doc_id long, node_id long, parent_id long, node_no int, kind string, preorder string"


def walk(rows):
    by, out = {}, {}
    for doc, node, parent, no, kind, _ in rows:
        by.setdefault((doc, parent), []).append((no, node, kind))
    for doc in {r[0] for r in rows}:
        stack, n = [(node, kind, 0, False) for _, node, kind in sorted(by.get((doc, None), []), key=lambda x: x[:2], reverse=True)], 0
        while stack:
            node, kind, level, under = stack.pop()
            out[doc, node] = (n, level, under)
            n += 1
            stack += [(c, k, level + 1, under or kind == "picture") for _, c, k in sorted(by.get((doc, node), []), key=lambda x: x[:2], reverse=True)]
    return out


def got(df):
    return {(r.doc_id, r.node_id): (r.preorder, r.level, r.under_picture) for r in df.collect() if r.reached}


def test_forests_with_circles_and_missing_parents(spark):
    draw = random.Random(6)
    rows = []
    for doc in range(5):
        for node in range(40):
            parent = None if node % 13 == 0 else draw.randint(0, node - 1)
            rows.append((doc, node, parent, draw.randint(0, 5), draw.choice(["text", "group", "picture", None]), "x"))
        rows += [(doc, 100, 101, 0, "text", "x"), (doc, 101, 100, 0, "picture", "x"), (doc, 102, 100, 0, "text", "x"), (doc, 103, 103, 0, "text", "x"),
                 (doc, 104, 999, 0, "text", "x"), (doc, 105, 104, 0, "text", "x")]
    df = spark.createDataFrame(rows, SCHEMA).drop("preorder").repartition(5)
    out = tree.document_order(df)
    assert out.count() == len(rows) and got(out) == walk(rows)
    assert out.where("reached").count() == 5 * 40 and out.where("NOT reached AND level IS NOT NULL").count() == 0
    assert tree.document_order(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_deep_and_wide_trees_in_few_rounds(spark, shape, monkeypatch):
    n, taken = 10_000, []
    sums = tree.tour_sums
    monkeypatch.setattr(tree, "tour_sums", lambda arcs: taken.append(sums(arcs)) or taken[-1])
    parent = F.when(F.col("id") > 0, F.col("id") - 1 if shape == "chain" else F.lit(0).cast("long"))
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("node_id"), parent.alias("parent_id"),
                               F.col("id").cast("int").alias("node_no"), F.lit("text").alias("kind"))
    out = tree.document_order(df)
    want = F.col("node_id") if shape == "chain" else F.when(F.col("node_id") > 0, 1).otherwise(0)
    assert out.where((F.col("preorder") == F.col("node_id")) & (F.col("level") == want)).count() == n and taken[0][1] <= 15
